"""Hand-made intervals with every relation; narrow bins must not change a result."""

import random

import pytest
from pyspark.sql import functions as F

from annospan.operators import intervals as iv

ROWS = [
    ("P1", "A", 1, 100), ("P1", "B", 20, 50), ("P1", "C", 90, 150), ("P1", "D", 151, 200), ("P1", "E", 201, 300), ("P1", "F", 300, 310),
    ("P2", "A", 5, 9), ("P3", "A", 1, 10), ("P3", "A", 30, 40), ("P5", "X", 1, 10), ("P5", "Y", 1, 10),
]


def crowd(n=300, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randint(1, 900)
        rows.append(("HOT" if i % 3 else f"Q{i % 5}", f"T{i}", s, s + rng.randint(0, 120)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "protein string, acc string, start int, end int")


def collect(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_overlap_groups_by_hand(spark):
    got = {(r.protein, r.acc, r.start): r for r in iv.domain_order(frame(spark, ROWS)).collect()}
    assert [got["P1", a, s].overlap_group_id for a, s in (("A", 1), ("B", 20), ("C", 90), ("D", 151), ("E", 201), ("F", 300))] == [1, 1, 1, 2, 3, 3]
    assert got["P1", "B", 20].overlap_relation_to_rep == "contained_in_rep"
    assert got["P1", "C", 90].overlap_relation_to_rep == "overlaps_rep"
    assert got["P1", "D", 151].gap_from_prev == 51 and not got["P1", "D", 151].adjacent_to_prev
    assert got["P1", "E", 201].gap_from_prev == 1 and got["P1", "E", 201].adjacent_to_prev
    assert got["P2", "A", 5].ordinal_label_nc == "N" and got["P1", "F", 300].ordinal_label_nc == "C"
    assert got["P5", "X", 1].is_representative and not got["P5", "Y", 1].is_representative
    assert got["P5", "Y", 1].overlap_relation_to_rep == "contained_in_rep"


@pytest.mark.parametrize("width", [1, 16, 100])
def test_bins_do_not_change_order(spark, width):
    df = frame(spark, crowd())
    cols = ["protein", "acc", "overlap_group_id", "ordinal_position_all", "representative_type", "gap_from_prev", "next_domain_type", "ordinal_label_nc"]
    key = lambda rows: sorted(rows, key=str)
    wide = key(tuple(r) for r in iv.domain_order(df, width=10_000).select(*cols).collect())
    assert key(tuple(r) for r in iv.domain_order(df, width=width).select(*cols).collect()) == wide


@pytest.mark.parametrize("width", [3, 50, 1000])
def test_overlap_join_is_exact(spark, width):
    left = frame(spark, crowd(120, 1))
    right = frame(spark, crowd(120, 2)).select("protein", F.col("acc").alias("f"), F.col("start").alias("fstart"), F.col("end").alias("fend"))
    got = collect(iv.overlap_join(left, right, ["protein"], width=width), "acc", "f", "overlap")
    want = sorted(
        (a, b, min(e, e2) - max(s, s2) + 1)
        for p, a, s, e in crowd(120, 1) for q, b, s2, e2 in crowd(120, 2) if p == q and s <= e2 and s2 <= e
    )
    assert got == want


@pytest.mark.parametrize("width", [5, 64])
def test_nearest_distance_is_exact(spark, width):
    left, feats = crowd(80, 3), crowd(20, 4)
    feat = frame(spark, feats).select("protein", F.col("start").alias("fstart"), F.col("end").alias("fend"))
    got = {r.acc: r.d for r in iv.nearest_distance(frame(spark, left), feat, "acc", "d", width=width).collect()}
    for p, a, s, e in left:
        ds = [max(s2 - e, s - e2, 0) for q, _, s2, e2 in feats if q == p]
        assert got[a] == (min(ds) if ds else None)


def test_proximity_thresholds(spark):
    df = frame(spark, [("P", "A", 100, 120)])
    def cats(ftype, s, e):
        feat = spark.createDataFrame([("P", s, e, ftype)], "protein string, fstart int, fend int, ftype string")
        return iv.proximity(df, feat, "acc").head()["proximity_categories"]
    assert cats("TRANSMEM", 150, 160) == "NearTransmembraneHelix" and cats("TRANSMEM", 151, 160) == ""
    assert cats("ACT_SITE", 130, 130) == "NearActiveSiteRegion" and cats("ACT_SITE", 131, 131) == ""
    assert cats("SIGNAL", 1, 80) == "NearSignalPeptideCleavage" and cats("SIGNAL", 1, 79) == ""


def test_insertion_needs_ten_residues(spark):
    seg = spark.createDataFrame(
        [("a", "P4", 10, 90, [(10, 20), (80, 90)]), ("b", "P4", 30, 60, [(30, 60)]), ("c", "P6", 10, 42, [(10, 24), (34, 42)]), ("d", "P6", 25, 33, [(25, 33)])],
        "key string, protein string, start int, end int, segments array<struct<start:int,end:int>>",
    )
    got = {r.key: r.insertion_category for r in iv.insertion_category(seg, "key").collect()}
    assert got == {"a": "InsertedDomain", "b": "", "c": "", "d": ""}


@pytest.mark.parametrize("fraction,status", [(30, "structured"), (31, "mixed"), (69, "mixed"), (70, "disordered")])
def test_disorder_bands(spark, fraction, status):
    df = frame(spark, [("P", "A", 1, 100)])
    feat = spark.createDataFrame([("P", 1, fraction)], "protein string, fstart int, fend int")
    assert iv.disorder_status(df, feat, "acc").head()["disorder_status"] == status


@pytest.mark.parametrize("n", [1, 7, 600])
def test_cooccurrence_has_one_row_per_other_at_any_size(spark, n):
    df = spark.createDataFrame([("P", f"k{i}", f"t{i}", i) for i in range(1, n + 1)], "protein string, key string, label string, ordinal_position_all int")
    rows = iv.cooccurring_occurrences(df, "key", block=64)
    assert rows.count() == n * (n - 1) == rows.select("key", "other_key").distinct().count()
    assert [r.other_label for r in rows.filter("key = 'k4'").orderBy("other_position").collect()] == [f"t{i}" for i in range(1, n + 1) if i != 4 and n > 1]


def test_a_second_scan_finds_rows_in_their_buckets(spark):
    """Order and groups come from two scans over the same bins; the rows are shuffled for the first one only."""
    rows = [("p", 5 * i, 5 * i + (9 if i % 4 else 2), f"a{i % 3}", i) for i in range(60)] + [("q", 0, 3, "a", 1)]
    df = spark.createDataFrame(rows, "protein string, start int, end int, acc string, t int")
    out = iv.overlap_groups(df, tie=["acc", "t"], width=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and "__bucket" not in plan and set(out.columns) == {*df.columns, "ordinal_position_all", "overlap_group_id"}
    group, reach, expected = 0, -1, {}
    for k, r in enumerate(sorted(r[1:] for r in rows if r[0] == "p")):
        group, reach = (group + 1 if r[0] > reach or not k else group), max(reach, r[1])
        expected[r[3]] = (k + 1, group)
    assert {r.t: (r.ordinal_position_all, r.overlap_group_id) for r in out.filter("protein = 'p'").collect()} == expected


def test_merged_entries_travel_slim(spark, monkeypatch):
    """Names, terms and members of an entry are no part of its merge and are not shuffled."""
    from annospan.plans.registry import QUERIES
    from annospan.sources import entries

    sent, merge = [], entries.merge_entry_sources
    monkeypatch.setattr(entries, "merge_entry_sources", lambda first, second: sent.append(first) or merge(first, second))
    QUERIES["s12_merge_sources"](spark, "/root/testdata/sf0.001")
    assert sent[0].select("e.metadata.*").columns == ["accession"]
