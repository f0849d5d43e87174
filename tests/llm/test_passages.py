"""Repeated passages against a plain version."""

import random
import re

import pytest

from annospan.llm import passages

from tests.llm.data import frame, rows, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(data, words=20):
    """(id, n_words, spans, kept) of (id, text) rows; a null id is the largest."""
    order = lambda i: (i is None, i or 0)
    split = [(i, WORD.findall(t or "")) for i, t in data]
    first = {}
    for i, t in split:
        for k in range(len(t) - words + 1):
            key = tuple(t[k : k + words])
            first[key] = min(first.get(key, (order(i), k)), (order(i), k))
    out = []
    for i, t in split:
        gone = [False] * len(t)
        for k in range(len(t) - words + 1):
            if first[tuple(t[k : k + words])] < (order(i), k):
                gone[k : k + words] = [True] * words
        edges = [k for k in range(len(t) + 1) if (k > 0 and gone[k - 1]) != (k < len(t) and gone[k])]
        out.append((i, len(t), list(zip(edges[::2], edges[1::2])), " ".join(w for w, g in zip(t, gone) if not g)))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def run(spark, data, **options):
    got = passages.remove_repeats(frame(spark, data), **options).collect()
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans)
    found = [(r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.kept) for r in got]
    return sorted(found, key=lambda r: ((r[0] is None, r[0] or 0), r[1:]))


def passage_rows():
    rng = random.Random(9)
    data = rows(40)
    shared = [text(rng, "en", n) for n in (19, 20, 21, 33, 60)]
    for k in range(60):
        parts = [text(rng, "de", rng.randint(0, 30)), rng.choice(shared), text(rng, "fr", rng.randint(0, 15)), rng.choice(shared)]
        rng.shuffle(parts)
        data.append((3000 + rng.randrange(10_000), rng.choice([" ", "\n", "\t\t "]).join(parts), "de", "a", 0, "", "", "", ""))
    data += [(8000, "same line " * 90, "en", "a", 0, "", "", "", ""), (7999, "same line " * 50, "en", "a", 0, "", "", "", "")]
    return data


@pytest.mark.parametrize("words", [1, 4, 20])
def test_remove_repeats_equals_brute_force(spark, words):
    data = passage_rows()
    assert run(spark, data, words=words) == brute_force([d[:2] for d in data], words)


def test_parts_of_hot_windows_agree(spark, monkeypatch):
    data = [(k % 300, "every document holds this very line of words " * 4 + f"and {k % 300} after", "en", "a", 0, "", "", "", "") for k in range(320)]
    expected = brute_force([d[:2] for d in data])
    assert run(spark, data) == expected
    monkeypatch.setattr(passages, "HOT_KEYS", 1)  # nothing is hot
    assert run(spark, data) == expected


def test_a_long_document_is_one_piece(spark, monkeypatch):
    monkeypatch.setattr(passages.buffers, "CHUNK_BYTES", 64)
    data = passage_rows()[:80]
    assert run(spark, data) == brute_force([d[:2] for d in data])


def test_no_documents(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("period", sorted(passages.COVERS))
def test_covers_meet_for_every_two_residues(period):
    cover = set(passages.COVERS[period])
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_cover_plan():
    assert passages.cover_plan(20) == (13, 8)
    assert passages.cover_plan(1) == (1, 1)
