"""Bit-mask draws against a plain sort of digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annospan.operators import enrichment as en, resample as rs


def digest(seed, i, e):
    return hashlib.md5(f"{seed}|{i}|{e}".encode()).hexdigest() + str(e)


def smallest(members, k, seed, i):
    return set(sorted(members, key=lambda e: digest(seed, i, e))[:k])


@pytest.mark.parametrize("n, size, fraction", [(3, 40, 0.8), (64, 25, 0.5), (70, 12, 1.0), (5, 1, 0.8)])
def test_subsample_takes_the_smallest_digests(spark, n, size, fraction):
    members = [f"e{i}" for i in range(size)]
    df = spark.createDataFrame([(e, x) for e in members for x in (1, 2)] + [(None, 1)], "e string, x int")
    got = {(r.iteration, r.e) for r in en.subsample(df, "e", n, fraction, 7).collect()}
    k = int(size * fraction)
    assert got == {(i, e) for i in range(1, n + 1) for e in smallest(members, k, 7, i)}


def test_buckets_with_several_digests(spark, monkeypatch):
    monkeypatch.setattr(rs, "DIGITS", 1)
    members = list(range(300))
    df = spark.createDataFrame([(e,) for e in members], "e long")
    got = {(r.iteration, r.e) for r in en.subsample(df, "e", 4, 0.37, 1).collect()}
    assert got == {(i, e) for i in range(1, 5) for e in smallest(members, 111, 1, i)}


def test_counts_of_masks(spark):
    pairs = [(f"e{i}", f"f{i % 3}") for i in range(30)] + [(f"e{i}", "all") for i in range(30)]
    df = spark.createDataFrame(pairs, "e string, f string")
    masks = en.subsample_masks(df, "e", 130, 0.4, 3)
    got = {(r.iteration, r.f): r.n for r in rs.mask_counts(df.join(masks, "e"), ["f"]).collect()}
    want = {}
    for i in range(1, 131):
        drawn = smallest({e for e, _ in pairs}, 12, 3, i)
        for e, f in pairs:
            if e in drawn:
                want[i, f] = want.get((i, f), 0) + 1
    assert got == want


def test_matched_draws_top_up_short_bins(spark):
    # Foreground: values 1..8. The background has few large values, so upper bins run short.
    fg = spark.createDataFrame([(f"a{i}", i % 8 + 1) for i in range(40)], "e string, n long")
    rows = [(f"b{i}", 1 if i < 50 else 3 if i < 58 else 8) for i in range(60)]
    bg = spark.createDataFrame(rows + [(None, 1)], "e string, n long")
    got = {}
    for r in en.matched_sample(fg, bg, "e", "n", 6, 5).collect():
        got.setdefault(r.iteration, set()).add(r.e)
    # Quartile edges of 1..8 (five of each): 1, 2.75, 4.5, 6.25, 8.
    bin_of = lambda v: sum(x <= v for x in (2.75, 4.5, 6.25)) + (v > 8)
    need = {}
    for i in range(40):
        b = bin_of(i % 8 + 1)
        need[b] = need.get(b, 0) + 1
    for i in range(1, 7):
        inside = set()
        for b in need:
            inside |= smallest([e for e, v in rows if bin_of(v) == b], need[b], 5, i)
        rest = smallest([e for e, _ in rows if e not in inside], 40 - len(inside), 5, i)
        assert got[i] == inside | rest
    assert len(got) == 6


def test_empty_table_draws_nothing(spark):
    df = spark.createDataFrame([], "e string, f string")
    assert en.subsample(df, "e", 4, 0.8, 1).count() == 0
    assert rs.mask_counts(df.join(en.subsample_masks(df, "e", 4, 0.8, 1), "e"), ["f"]).count() == 0


def test_pairs_are_not_copied_per_draw(spark):
    df = spark.createDataFrame([(f"e{i}", f"f{i % 5}") for i in range(50)], "e string, f string")
    masks = en.subsample_masks(df, "e", 100, 0.8, 1)
    counts = rs.mask_counts(df.join(masks, "e"), ["f"])
    # Two mask words at most per feature reach the counters' shuffle.
    assert counts.agg(F.countDistinct("iteration")).first()[0] == 100
    joined = df.join(masks, "e")
    assert joined.count() == 50 and {len(r.mask) for r in joined.collect()} == {2}


def test_cuts_are_found_without_a_row_per_draw(spark):
    """Digests of all draws were rows of a shuffle; a task now sends one array of counts per draw."""
    members = [f"é{i}" for i in range(400)] + ["x" * 60]
    df = spark.createDataFrame([(e, len(e) % 2, 90) for e in members], "e string, s int, q long")
    cuts = rs.digest_cuts(df, "e", "q", 5, 3, "s")
    for at, s in enumerate(cuts.strata):
        group = [e for e in members if len(e) % 2 == s]
        for i in range(5):
            assert cuts.whole[at, i] == (len(group) < 90)
            if len(group) >= 90:
                last = sorted(digest(3, i + 1, e) for e in group)[89]
                assert f"{int(cuts.high[at, i]):016x}{int(cuts.low[at, i]):016x}{cuts.text[at][i]}" == last
    plan = rs.draw_masks(df, "e", 5, 3, ("s", cuts))._jdf.queryExecution().toString()
    assert "md5" not in plan and "Exchange" not in plan


def test_long_sums_of_repeated_tests_are_spread(spark):
    """All tests of all draws met in one task, as their few rows make one small partition."""
    from math import comb

    from annospan.functions import stats

    rows = [(900 + i % 50, 2100 - i % 50, 6000 + i, 14000 - i) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    out = stats.with_fisher_greater(df, "p", *[F.col(c) for c in "abcd"], repeated=True)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()
    for r in out.limit(5).collect():
        n, good, draws = r.a + r.b + r.c + r.d, r.a + r.c, r.a + r.b
        part = sum(comb(good, k) * comb(n - good, draws - k) for k in range(r.a, min(good, draws) + 1))
        whole = comb(n, draws)
        assert r.p == pytest.approx(part * 10**30 // whole / 1e30, rel=1e-8)
