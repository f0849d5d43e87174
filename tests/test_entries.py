"""Entries of other kinds, and how often an entry is parsed."""

from __future__ import annotations

import json

from annospan.sources import entries


def entry(kind, source, members={"pfam": {"PF1": "x"}}):
    place = [{"accession": "p1", "entry_protein_locations": [{"fragments": [{"start": 1, "end": 9}]}]}]
    return json.dumps({"metadata": {"accession": "A", "name": "n", "type": kind, "source_database": source, "member_databases": members}, "proteins": place})


def test_only_wanted_entries_and_one_parser(spark):
    rows = [("P1", entry(" Domain", "pfam")), ("P1", entry("family", "InterPro ")), ("P1", entry(None, None)), ("P1", "{"), ("P1", entry("domain", "interpro", None))]
    df = entries.parse_entries(spark.createDataFrame(rows, "accession string, entry string"))
    domains, members = entries.entries_to_domains(df), entries.entry_members(df)
    assert [r["ranges"] for r in domains.collect()] == ["1..9", "1..9"]
    assert [tuple(r) for r in members.collect()] == [("A", "n", "pfam", "PF1", "x")]
    for out in (domains, members):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
