"""Language, toxicity and quality: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pytest

from annospan.llm import buffers, language, quality, toxicity

from tests.llm.data import frame, rows, text


def held(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_language_of_held_out_documents(spark):
    rng = random.Random(4)
    data = []
    for i in range(240):
        lang = rng.choice(["en", "de", "fr"])
        data.append((i, text(rng, lang, rng.randint(20, 200)), lang, "a", 0, "", "", "", ""))
    data += [(i + 1000, t, *r) for i, (_, t, *r) in enumerate(rows(5)[5:])]
    got = {r.doc_id: r for r in language.identify_languages(frame(spark, data)).collect()}
    assert set(got) == {d[0] for d in data}
    tested = [d for d in data[:240] if held(d[0], 4) == 2]
    assert all(got[d[0]].held_out for d in tested)
    assert sum(got[d[0]].lang_pred == d[2] for d in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())
    lettered = {d[0]: any(c.isalpha() for c in d[1] or "") for d in data}
    assert all((r.lang_pred == "und") == (not lettered[i]) for i, r in got.items())


def test_language_without_labels_or_rows(spark):
    assert language.identify_languages(frame(spark, [])).collect() == []
    data = [(1, "some text", None, "a", 0, "", "", "", ""), (None, "x", None, None, 0, "", "", "", "")]
    assert {r.lang_pred for r in language.identify_languages(frame(spark, data)).collect()} == {"und"}


def test_pair_tables_equal_the_filters():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (20, language.WINDOW)).astype(np.uint8)
    net = language.fit_network(windows, rng.integers(0, 2, 20), ["a", "b"], epochs=1)
    assert np.allclose(language.pooled(net, windows.astype(np.int64)), language.PairTables(net).pooled(windows), atol=1e-5)


def test_windows_cover_every_byte():
    offsets = np.array([0, 0, 3, 259, 1000])
    start, row = language.window_starts(offsets)
    for r in range(4):
        covered = set()
        for s in start[row == r]:
            assert s >= offsets[r]
            covered |= set(range(s, min(s + language.WINDOW, offsets[r + 1])))
        assert covered == set(range(offsets[r], offsets[r + 1]))


def toxic_rows(n=300):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(n):
        words = text(rng, "en", rng.randint(20, 80)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "zorkan", "zorkel", "zorkit", "zork" + rng.choice("abcdefgh")]))
        data.append((i, " ".join(words), "en", "a", 0, "", "", "", ""))
        labels.append((i, 1, int(bad)))
    return data, labels


def test_toxicity_on_held_out_documents(spark):
    data, labels = toxic_rows()
    extra = [(1000 + k, t, *r) for k, (_, t, *r) in enumerate(rows(3)[3:])]
    out = toxicity.score_toxicity(frame(spark, data + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    tested = [i for i, _, _ in labels if held(i, 5) == 0]
    right = sum(got[i].rejected == bool(labels[i][2]) for i in tested)
    assert right >= 0.95 * len(tested)
    for r in got.values():
        assert 0 <= r.severity <= 3 and 0 <= r.grade <= 3 and r.rejected == (r.p_toxic >= 0.5)
    assert not got[1000].rejected and out.columns[: len(extra[0])] == frame(spark, []).columns


def test_toxicity_thresholds_are_ordered_and_share_weights():
    data, labels = toxic_rows()
    model = toxicity.fit_ordinal([d[1] for d in data], np.array([y for _, _, y in labels]))
    assert (np.diff(model.thresholds) > 0).all()
    p = model.exceed(np.linspace(-5, 20, 30))
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(p, axis=0) >= 0).all()


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(frame(spark, []), labels).collect() == []
    assert not any(r.rejected for r in toxicity.score_toxicity(frame(spark), labels).collect())


def quality_rows(n=400):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(n):
        t = text(rng, "en", rng.randint(20, 60))
        bad = rng.random() < 0.2
        if bad:
            t = rng.choice([t.replace(" ", "### "), t.replace(" ", " | "), " ".join(w for w in t.split()[:5] for _ in range(12)), t.upper().replace(" ", "!! ")])
        data.append((i, t, "en", "a", 0, "", "", "", ""))
        labels.append((i, int(not bad), 0))
    return data, labels


def test_quality_on_held_out_documents(spark):
    data, labels = quality_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, data + [(i + 1000 if i is not None else i, *r) for i, *r in rows(3)[3:]])
    got = quality.score_quality(docs, known).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    found = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id > 10}
    tested = [i for i in found if held(i, 5) == 0]
    assert all(found[i].held_out for i in tested)
    assert sum(found[i].predicted == labels[i][1] for i in tested) >= 0.95 * len(tested)
    kept = quality.keep_quality(docs, known)
    assert kept.columns == docs.columns
    stays = {r.doc_id for r in kept.collect()}
    agree = sum((i in stays) == bool(found[i].predicted) for i in found)
    assert agree >= 0.98 * len(found)


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(frame(spark, []), labels).collect() == []
    assert {r.score for r in quality.score_quality(frame(spark), labels).collect()} == {0.5}
    assert quality.keep_quality(frame(spark), labels).count() == frame(spark).count()


def test_statistics_equal_a_plain_count():
    texts = ["", "Aa bb bb bb 12", "x | y\n## É!", " lead", "é" * 50]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = quality.row_statistics(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    names = {c: i for i, c in enumerate(quality.STATS)}
    for t, r, row in zip(texts, raw, got):
        words = r.split()
        assert row[names["log_words"]] == pytest.approx(np.log1p(len(words)))
        assert row[names["bars"]] == pytest.approx(r.count(b"|") / max(len(r), 1))
        assert row[names["bytes_per_char"]] == pytest.approx(len(r) / max(len(t), 1))
        assert row[names["repeats"]] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1))
    assert np.array_equal(buffers.chunks(offsets, 10).__next__(), (0, 1))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality.STATS)))
    y = (x[:, 0] + x[:, 3] ** 2 > 0.5).astype(float)
    model = quality.fit_trees(x, y, trees=20, depth=3)
    for row, got in zip(x[:40], model.margin(x[:40])):
        want = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            want += v[node - len(f)]
        assert got == pytest.approx(want)
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.9
