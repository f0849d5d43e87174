"""Each stage judged on its own input, and the registered queries on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from annospan.llm.queries import QUERIES
from annospan.llm.tables import DOCUMENT_COLUMNS, table

from tests.llm.data import brute_classes, text

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = docs.collect()
        assert after
        if n < 4:
            assert docs.columns == DOCUMENT_COLUMNS
        ids = [r.doc_id for r in after]
        if n < 3:
            assert len(set(ids)) == len(ids) and set(after) <= set(before)
        if name == "toxicity":
            assert len(toxic & set(ids)) <= 0.5 * len(toxic)  # nine labelled ones to learn from
            assert len(before) - len(after) <= 2 * len(toxic) + 0.1 * len(before)
        if name == "n-gram Jaccard join":
            want = brute_classes({r.doc_id: r.text for r in before})
            assert sorted(ids) == sorted(set(want.values()))
        if name == "best-fit packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            used = {}
            for r in after:
                used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
            assert max(used.values()) <= 2048


ODD = "doc_id long, text string, lang string, source string, n_chars long, grade string, severity string, rejected string, toxic int, quality int, _cue string, _id string, _th string, _h string, _rank string, _parts string, _copies string, mix_text string"


def odd_rows():
    """Nulls in every column, an empty, a blank and a very long text, repeated rows, one id and text in two sources, clashing names."""
    rng = random.Random(5)
    clash = ("keep", "high", "no", 7, 8, "c", "i", "t", "h", "r", "p", "k", "m")
    base = [(k, text(rng, "en", 60), "en", rng.choice(["a", "b"]), 9) for k in range(40)]
    odd = [
        (100, base[0][1] + " and more of it", "en", "a", 1), (100, base[0][1] + " and more of it", "en", "b", 1), base[1], base[1], (101, "", "en", "a", 0),
        (102, " \n ", "en", None, 3), (103, None, None, None, None), (None, text(rng, "de", 50), "de", "a", 5), (104, text(rng, "fr", 30_000), "fr", "b", 6), (None,) * 5,
    ]
    return [(*r, *clash) for r in base + odd] + [(None,) * 18]


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_keep_odd_rows_and_clashing_columns(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, ODD)
    known = Counter(rows)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(known)  # no value of a row changes
        if n < 3:
            assert all(c <= known[r] for r, c in Counter(got).items())
    packed = corpus_pipeline.STAGES[4][1](spark, frame, SF)
    assert packed.count() >= len(rows)


def test_the_mix_keeps_the_source_it_draws(spark):
    from annospan.llm import mixing

    rows = [(1, "word " * 50, "en", s, 0) for s in "abc"] + [(k, "other " * 50, "en", "a", 0) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.taken_words(docs, (5, 2, 1), 3, 128, 11, "doc_id", "text", "source")
    codes = {r.sh: r.source for r in docs.select("source", mixing.source_hash("source").alias("sh")).distinct().collect()}
    want = Counter({(r.id, codes[r.sh]): r.passes for r in taken.collect() if r.passes})
    assert Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect()) == want


def test_run_gives_packed_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "piece", "start", "length", "sequence_id", "offset"}
    assert out.count() > 0


@pytest.mark.parametrize("name", ["op3_toxicity_ordinal", "op10_shard_bytes"])
def test_queries_cover_their_table(spark, name):
    assert QUERIES[name](spark, SF).count() == table(spark, SF, "documents").count()
