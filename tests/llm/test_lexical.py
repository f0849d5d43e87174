"""Ranked search against a plain version."""

import math
import random
import re

import numpy as np
import pytest

from annospan.llm import lexical

from tests.llm.data import frame, rows, text

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, rank int, score string, doc_id string"


def terms(t):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]


def brute_force(docs, items, top=50):
    split = [(i, terms(t)) for i, t in docs]
    split = [(i, t) for i, t in split if t]
    n_docs, total = len(split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, t in items:
        scores = []
        for i, d in split:
            m = 50 + (50 * len(d) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * d.count(w)) // (1000 * d.count(w) + 20 * m)) for w in set(terms(t)) if w in df)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


def run(spark, docs, items, **options):
    frame_of_items = spark.createDataFrame([(i, t, 1, "s", "d") for i, t in items], ITEMS)
    got = lexical.ranked_search(frame(spark, docs), frame_of_items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] is None, r[2] or 0))


def searched(seed=5, n=150):
    rng = random.Random(seed)
    docs = rows(n, seed)
    items = [(k, text(rng, lang, size)) for k, (lang, size) in enumerate([("en", 12), ("de", 6), ("fr", 9), ("en", 1), ("de", 40), ("fr", 3), ("en", 25)])]
    items += [(50, None), (51, ""), (52, "!!! ---"), (53, "absentword"), (54, docs[3][1]), (54, docs[4][1]), (55, docs[3][1]), (None, docs[5][1] + " 123 GRÖSSE größe")]
    return docs, items


@pytest.mark.parametrize("top", [1, 5, 50])
def test_search_equals_brute_force(spark, top):
    docs, items = searched()
    assert run(spark, docs, items, top=top) == brute_force([d[:2] for d in docs], items, top)


def test_blocks_samples_and_integers(spark, monkeypatch):
    docs, items = searched(6)
    expected = brute_force([d[:2] for d in docs], items, 5)
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 4)
    monkeypatch.setattr(lexical, "FIRST_SAMPLE", 20)
    monkeypatch.setattr(lexical, "SAMPLE_STEP", 3)
    monkeypatch.setattr(lexical, "COLUMNS_AT_ONCE", 3)
    monkeypatch.setattr(lexical, "EXACT", 1)
    assert run(spark, docs, items, top=5) == expected


def test_ties_go_to_the_smaller_id(spark):
    docs = [(k, "alpha beta" if k % 2 else "gamma", "en", "a", 0, "", "", "", "") for k in range(200, 0, -1)]
    assert run(spark, docs, [(1, "Beta ALPHA")], top=7) == brute_force([d[:2] for d in docs], [(1, "Beta ALPHA")], 7)


def test_nothing_to_search(spark):
    docs, items = searched()
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, docs, [(1, None), (2, " - ")]) == []


def test_tree_leaves_pairs_of_nodes_and_stays_exact():
    rng = np.random.default_rng(2)
    groups, width, n, m = 16, 320, 2048, 64
    column = lambda g: np.sort(rng.choice(20, 8, replace=False)) + 20 * g
    group = rng.integers(0, groups, n)
    docs = lexical.Sparse(np.arange(n + 1) * 8, np.concatenate([column(g) for g in group]), rng.integers(1, 1000, n * 8).astype(float))
    items = lexical.Sparse(np.arange(m + 1) * 8, np.concatenate([column(g % groups) for g in range(m)]), rng.integers(1, 1000, m * 8).astype(float))
    items = items.take(lexical.tree_order(items, 4))
    block = lexical.Items([str(k) for k in range(m)], np.arange(width), [items.maxima(s) if s > 1 else items for s in lexical.ITEM_LEVELS])
    best = lexical.Best(m, 10, np.zeros(m), np.float64)
    scored = sum(
        lexical.search(docs.take(np.arange(a, a + 1024)), np.arange(a, a + 1024), np.zeros(1024, int), block, best) for a in range(0, n, 1024)
    )
    full = lexical.products(docs, slice(0, n), items, slice(0, m), width)
    assert scored < 0.2 * n * m
    for k in range(m):
        expected = np.lexsort((np.arange(n), -full[:, k]))[:10]
        assert (best.order[k] == expected).all() and (best.score[k] == full[expected, k]).all()
