"""Permutations in blocks against plain numbering."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annospan.functions.digests import digest_table, text_array
from annospan.operators.permutation import permute, shuffled_counts
from annospan.operators.transfer import F1Sums, bootstrap_ci, random_control


def plain(pairs, n, seed):
    digest = lambda head, p: hashlib.md5(f"{seed}|{head}|{p[0]}|{p[1]}".encode()).hexdigest()
    fixed = sorted(pairs, key=lambda p: digest("fixed", p))
    return {
        (i, a[0], b[1]) for i in range(1, n + 1) for a, b in zip(fixed, sorted(pairs, key=lambda p: digest(i, p)))
    }


def test_blocks_equal_plain_numbering(spark):
    pairs = [(f"e{i}", i * 3) for i in range(200)]
    df = spark.createDataFrame(pairs, "e string, f long")
    for draws in (40, 1_000_000):
        rows = [tuple(r) for r in permute(df, "e", "f", 4, 7, block_draws=draws).select("iteration", "e", "f").collect()]
        assert len(rows) == 800 and set(rows) == plain(pairs, 4, 7)


def test_no_exploded_draws_are_broadcast(spark):
    """The draws are many times the table that Spark sees; they meet the rows in a cogroup, not in a join."""
    df = spark.range(300).select(F.col("id").cast("string").alias("e"), F.col("id").alias("f"))
    plan = permute(df, "e", "f", 50, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "explode(sequence(1, 50" not in plan


def test_random_control_equals_loops_and_broadcasts_no_draws(spark):
    ann = [(s, c, f"{c}{t}") for s in range(9) for c in ("a", "b") for t in range(4) if (s * 5 + t) % 3 and (s, c) != (4, "b")]
    gold = [(t, c, f"{c}{x}") for t in range(20, 26) for c in ("a", "b") for x in range(4) if (t + x) % 2 and (t, c) != (22, "a")]
    out = random_control(
        spark.createDataFrame(gold, "target int, category string, term_value string"),
        spark.createDataFrame(ann, "source int, category string, term_value string"), ["a", "b"], n=5, digits=(8, 6),
    )
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sources = sorted({r[0] for r in ann}, key=lambda x: md5(str(x)) + str(x))
    for row in out.collect():
        scores = []
        for i in range(1, 6):
            source = sources[int(md5(f"42|{row.target}|{row.category}|{i}")[:13], 16) % len(sources)]
            p = {r[2] for r in ann if r[:2] == (source, row.category)}
            g = {r[2] for r in gold if r[:2] == (row.target, row.category)}
            scores.append(round(len(p & g) / len(p | g), 4) if p | g else 1.0)
        assert abs(row.jaccard - sum(scores) / 5) < 1e-7
    assert out.count() == 12
    above = out._jdf.queryExecution().optimizedPlan().toString().split("explode(sequence(1, 5")[0]
    assert "Join Inner" not in above and "Join LeftOuter" in above


def test_summed_f1_equals_loops(spark):
    """Several sources per target, targets without pairs or terms, more than one mask word."""
    ann = [(s, c, f"{c}{t}") for s in range(12) for c in "ab" for t in range(40) if (s * 7 + t * 3) % 5 < 2 and (s, c) != (4, "b")]
    gold = [(t, c, f"{c}{x}") for t in range(20, 27) for c in "ab" for x in range(45) if (t * x) % 4 == 1 and (t, c) != (23, "a")]
    for pairs in ([(s, 20 + s % 5) for s in range(12)] + [(3, 99)], [(s, 20 + s) for s in range(6)]):
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        df = frame(pairs, "source int, target int")
        sums = F1Sums(df, frame(ann, "source int, category string, term_value string"), frame(gold, "target int, category string, term_value string"), ["a", "b", "c"])
        got = {r.category: r.total for r in sums(df).collect()}
        targets = {r[0] for r in gold}
        for c in "abc":
            total = 0
            for t in targets:
                p = {r[2] for r in ann if r[1] == c and (r[0], t) in pairs}
                g = {r[2] for r in gold if r[:2] == (t, c)}
                tp = len(p & g)
                total += round(2 * tp / (len(p) + len(g)), 4) * 10_000 if p or g else 10_000
            assert got[c] == round(total)


def test_bootstrap_in_tasks_equals_joined_draws(spark):
    """Both ways, nulls among the values included, against a loop over the digests."""
    rows = [("a" if i % 3 else "b", i, None if i % 7 == 0 else i * 1.5) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, id int, x double")
    held, joined = ({r.g: tuple(r)[1:] for r in bootstrap_ci(df, "x", ["g"], "id", n=30, held=h).collect()} for h in (2_000, 0))
    assert held == joined and len(held) == 2
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for g in "ab":
        x = [r[2] for r in sorted((r for r in rows if r[0] == g), key=lambda r: md5(str(r[1])))]
        drawn = [[x[int(md5(f"42|{g}|{i}|{k}")[:13], 16) % len(x)] for k in range(1, len(x) + 1)] for i in range(1, 31)]
        means = [sum(v for v in d if v is not None) / sum(v is not None for v in d) for d in drawn]
        assert abs(held[g][0] - sum(means) / 30) < 1e-4


@pytest.mark.parametrize("move", ["f", "e"])
def test_counts_of_shuffled_pairs_equal_loops_and_send_no_row_per_draw(spark, move):
    """Pairs that a shuffle makes twice count once, in one block and bucket or many."""
    pairs = sorted({(i % 37, (i * i) % 11) for i in range(400)})
    keep = "e" if move == "f" else "f"
    df = spark.createDataFrame(pairs, "e int, f byte").withColumn("id", F.concat_ws("|", keep, move))
    named = pairs if move == "f" else [(f, e) for e, f in pairs]
    made = {(i, a, b) if move == "f" else (i, b, a) for i, a, b in plain(named, 6, 7)}
    expected = {}
    for i, _, f in made:
        expected[i, f] = expected.get((i, f), 0) + 1
    for draws, bucket in ((50, 100), (1_000_000, 1_000_000)):
        out = shuffled_counts(df, "e", "f", move, 6, 7, "id", block_draws=draws, bucket_draws=bucket)
        assert {(r.iteration, r.f): r.n for r in out.collect()} == expected
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__digest" in plan and "__high" not in plan  # draws travel as arrays


def test_digests_equal_hashlib():
    texts = ["", "a", "é|ü", *[str(i) * (i % 30 + 1) for i in range(300)]]
    starts = ["42|1|", "42|fixed|", "42|10000|"]
    high, low = digest_table(starts, *text_array(pa.array(texts)))
    for k, s in enumerate(starts):
        for i, t in enumerate(texts):
            assert f"{high[k, i]:016x}{low[k, i]:016x}" == hashlib.md5((s + t).encode()).hexdigest()
