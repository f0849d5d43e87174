"""Sharding and mixing: laws on odd rows, empty tables and hot groups."""

import re
import zlib

import pytest

from annospan.llm import mixing, sharding
from annospan.llm.components import components

from tests.llm.data import frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards_are_balanced_contiguous_and_numbered(spark):
    data = rows(400) + [(1000 + i, "the same text again", "en", "a", 0, "", "", "", "") for i in range(200)]
    got = sharding.shard_by_bytes(frame(spark, data), shards=4).collect()
    assert len(got) == len(data)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted(
        (d[0] is None, d[0] or 0, size(d[1]), zlib.crc32((d[1] or "").encode())) for d in data
    )
    total = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    largest = max(size(d[1]) for d in data)
    assert max(total) - min(total) <= 2 * largest
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_small_groups_stay_whole_and_hot_ones_are_cut(spark):
    data = [(i, f"text number {i // 3}", "en", "a", 0, "", "", "", "") for i in range(600)]
    data += [(10_000 + i, "hot", "en", "a", 0, "", "", "", "") for i in range(3000)]
    got = sharding.shard_by_bytes(frame(spark, data), shards=3, together=0.02).collect()
    of = {}
    for r in got:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for c, s in of.items() if c != zlib.crc32(b"hot"))
    total = [sum(r["size"] for r in got if r.shard == s) for s in range(3)]
    assert max(total) <= 1.05 * min(total)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert sharding.shard_by_bytes(empty).collect() == []
    assert mixing.mix_sources(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def water_level(sizes, weights, repeats):
    """Targets by raising the level of uncapped sources until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("block", [1, 16, 128])
def test_mix_reaches_targets(spark, block):
    data = rows(120) + [(500 + i, "tiny", "en", "zz", 0, "", "", "", "") for i in range(2)]
    got = mixing.mix_sources(frame(spark, data), block=block)
    again = mixing.mix_sources(frame(spark, data), block=block)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    got, again = sorted(got.collect(), key=key), sorted(again.collect(), key=key)
    assert got == again and len(got) == len(data)
    count = lambda t: len(WORD.findall(t or ""))
    sizes, source = {}, {}
    for d in data:
        sizes[d[3]] = sizes.get(d[3], 0) + count(d[1])
        source[d[0]] = d[3]
    want = water_level(sizes, (5, 2, 1), 3)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.taken <= 3 * r["size"] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
        taken[source[r.doc_id]] += r.taken
    assert all(taken[s] == pytest.approx(want[s], abs=1) for s in sizes)


def test_schedule_spreads_sources(spark):
    targets = spark.createDataFrame([("a", 0, 6000, 6000.0), ("b", 1, 3000, 3000.0), ("c", 2, 1000, 1000.0)], "source string, number int, source_size long, target double")
    slots = sorted(mixing.golden_schedule(targets, 10).collect(), key=lambda r: r.slot)
    for n in (100, 500, 900):
        seen = [sum(r.number == k for r in slots[:n]) / n for k in range(3)]
        assert seen == pytest.approx([0.6, 0.3, 0.1], abs=0.05)
    assert sum(r.length for r in slots) == 10_000


def test_mixed_documents_keep_columns_and_copies(spark):
    docs = frame(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in mixing.mix_sources(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.passes
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in taken.items() if v}
