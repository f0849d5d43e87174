"""Tokens round trip through the tokenizer; packing keeps every capacity."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annospan.llm import packing

from tests.llm.data import frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abAZ zéÉ.,'!#5ß÷—\u0301İΣ\n\t\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "'s", "...", "größe,", "été."]), max_size=30))
def test_chunks_give_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    words = packing.WordIds(PATH)
    raw = text.encode()
    assert np.frombuffer(words.of(raw), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_restore_every_document(spark, tokenizer):
    data = rows(20)
    want = {}
    for d in data:
        want.setdefault(d[0], []).append(ids_of(tokenizer, d[1]))
    got = {}
    for r in packing.token_pieces(frame(spark, data), PATH, limit=64).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64 and r.start == 64 * r.piece
        got.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(ids)
    for doc, texts in want.items():
        if len(texts) == 1:
            assert [x for p in sorted(got[doc]) for x in got[doc][p][0]] == texts[0]
        else:
            assert all(len(v) == len(texts) for v in got[doc].values())


def test_whole_text_mode_agrees(spark):
    data = rows(6)[:6]
    pick = lambda by_word: sorted((r.doc_id, r.piece, bytes(r.ids)) for r in packing.token_pieces(frame(spark, data), PATH, by_word=by_word).collect())
    assert pick(True) == pick(False)


def test_packing_is_gapless_and_tight(spark):
    data = rows(300) + [(900 + i, "equal text", "en", "a", 0, "", "", "", "") for i in range(300)]
    got = packing.pack_documents(frame(spark, data), PATH, limit=128).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length, zlib.crc32(bytes(r.ids))))
    for items in bins.values():
        at = 0
        for offset, length, _ in sorted(items):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) + 2
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(
    st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 6), st.integers(600, 3000), st.sampled_from(["norm", "dot"]),
)
def test_every_capacity_holds(histogram, documents, attention, score):
    attention = max(attention, max(histogram) ** 2)
    plan = packing.best_fit(list(histogram), list(histogram.values()), 40, documents=documents, attention=attention, score=score)
    load, placed = {}, dict.fromkeys(histogram, 0)
    for length, first, n, each, base, offset in zip(*plan[:6]):
        assert first == placed[length]
        placed[length] += n * each
        for b in range(base, base + n):
            tokens, docs, cost = load.get(b, (0, 0, 0))
            assert tokens == offset
            load[b] = tokens + length * each, docs + each, cost + each * length * length
    assert placed == histogram and set(load) == set(range(plan.total))
    assert all(t <= 40 and d <= documents and c <= attention for t, d, c in load.values())


def test_too_long_a_piece_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit([10], [1], tokens=8)
