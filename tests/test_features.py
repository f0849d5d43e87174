"""Feature lines of flat-file records."""

from __future__ import annotations

from annospan.sources import flatfile

RECORD = "\n".join([
    "ID   X", "FT                   stray", "FT   REGION          3..<9 rest", 'FT                   /note="a  b"', "FT                   more", "FT                   /k=1",
    "FT                   /k=2", 'FT                   /Note="c"', "FT                   /FTId=F1", "FT                   /FTId=F2", "FT   domain          >5", "FT   not a header",
    "FT   DOMAIN          7..8", "SQ   x",
])


def test_features_and_their_numbers(spark):
    out = flatfile.flat_features(spark.createDataFrame([(RECORD,), ("ID   Y",), (None,)], "record string"))
    first, second, third = out.collect()
    region, one, two = first["features"]
    assert (region["type"], region["start"], region["end"], region["note"], region["ftid"]) == ("REGION", 3, 9, "rest a b more c", "F2")
    assert region["qualifiers"] == {"note": ["a b"], "k": ["1", "2"], "Note": ["c"], "FTId": ["F1", "F2"]}
    assert (one["type"], one["start"], one["end"], one["note"], one["qualifiers"]) == ("DOMAIN", 5, 5, "", {})
    assert (two["type"], two["start"], two["end"]) == ("DOMAIN", 7, 8)
    assert (first["n_features"], first["region_count"], first["domain_count"], first["motif_count"]) == (3, 1, 2, 0)
    assert (second["n_features"], second["features"]) == (0, [])
    assert third["features"] is None


def test_numbers_need_no_features(spark):
    out = flatfile.flat_features(spark.createDataFrame([(RECORD,)], "record string")).select("n_features", "region_count")
    assert "qualifiers" not in out._jdf.queryExecution().optimizedPlan().toString()
