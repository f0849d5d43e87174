"""Whitening against a dense numpy version."""

import numpy as np
import pytest

from annospan.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, x string, width string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "x", "w") for i, v in vectors], SCHEMA)


def dense(vectors, k=4):
    """(n, deviations, whitened, explained) with Python integers and numpy."""
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    own = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    return n, deviation, own @ axes / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e9])
def test_whitening_equals_dense_version(spark, scale):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2])) * scale
    vectors = [(i, [float(c) for c in base[i % 250]]) for i in range(300)]
    got = sorted(whitening.whiten_vectors(frame(spark, vectors)).collect(), key=lambda r: r.vec_id)
    n, deviation, white, explained = dense([v for _, v in vectors])
    assert {r.n for r in got} == {n} and len(got) == 300
    assert [r.deviation for r in got] == [d if d < 1 << 63 else None for d in deviation]
    assert np.allclose(np.abs([r.whitened for r in got]), np.abs(white), atol=1e-7)
    assert np.allclose([r.explained for r in got], explained, rtol=1e-9)
    assert got[0].identity_error < 1e-9


def test_exact_sums_of_large_numbers():
    rng = np.random.default_rng(1)
    y = rng.integers(-(1 << 60), 1 << 60, size=(50, 3))
    whole = y.astype(object)
    expected = [sum((a + b) ** 2 for a, b in zip(whole[:, i], whole[:, j])) for i in range(3) for j in range(i, 3)]
    assert list(whitening.pair_squares(y)) == expected
    assert list(whitening.column_sums(y)) == list(whole.sum(axis=0))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [3.0, -4.0]),
        (7, [5.0]), (8, [0.0, 0.0, 0.0]), (9, [1e300, 0.0, 0.0]), (10, [-1e300, 0.0, 0.0]),
    ]
    got = whitening.whiten_vectors(frame(spark, vectors)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.width, r.n) for r in got) == [
        (False, 5, 0, None), (False, 6, 2, 2), (False, 6, 2, 2), (False, 7, 1, 1), (False, 8, 3, 3), (False, 9, 3, 3), (False, 10, 3, 3), (True, 0, 2, 2),
    ]
    by_id = {r.vec_id: r for r in got}
    assert abs(by_id[6].whitened[0] + by_id[None].whitened[0]) < 1e-12 and abs(abs(by_id[6].whitened[0]) - 1) < 1e-12
    assert by_id[6].whitened[1] == 0.0 and by_id[7].whitened == [0.0]
    assert by_id[9].deviation is None and abs(by_id[9].whitened[0]) > 1
    assert all(r.identity_error < 1e-9 for r in got)


def test_no_vectors(spark):
    assert whitening.whiten_vectors(frame(spark, [])).collect() == []


def test_query_rows(spark):
    df = queries.op12_whitening(spark, "/root/testdata/sf0.001")
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = df.collect()
    assert {r.component for r in rows} == {1, 2, 3, 4}
    assert len(rows) == 4 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
