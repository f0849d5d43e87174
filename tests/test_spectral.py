"""Eigenpairs, tile sums, tree cuts and permutation batches against dense versions."""

import random

import numpy as np
import pytest

from annospan.operators import similarity as si
from annospan.operators import spectral, tiles
from annospan.operators.blocks import token_sets


def distances(n, seed=0, share=0.6):
    rng = np.random.default_rng(seed)
    place = rng.normal(size=(n, 3)) * np.array([0.3, 0.2, 0.1])
    far = lambda i, j: float(np.linalg.norm(place[i] - place[j]))
    return [(i, j, far(i, j)) for i in range(n) for j in range(i + 1, n) if far(i, j) < 1 and rng.random() < share]


def dense_scaling(n, pairs):
    d = np.ones((n, n))
    np.fill_diagonal(d, 0.0)
    for i, j, x in pairs:
        d[i, j] = d[j, i] = x
    centre = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    return values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("exact", [512, 4])
def test_principal_coordinates_equal_a_dense_solver(spark, monkeypatch, exact):
    monkeypatch.setattr(spectral, "EXACT_IDS", exact)
    n, pairs = 30, distances(30)
    frame = spark.createDataFrame(pairs, "a long, b long, distance double")
    coordinates, axes = spectral.principal_coordinates(frame, spark.range(n), k=2)
    values, vectors = dense_scaling(n, pairs)
    found = {r.axis: r for r in axes.collect()}
    assert [found[i].eigenvalue for i in (1, 2)] == pytest.approx(values[:2], rel=1e-8)
    got = np.zeros((n, 2))
    for r in coordinates.collect():
        got[r.id, r.axis - 1] = r.coordinate
    assert np.allclose(np.abs(got), np.abs(vectors[:, :2] * np.sqrt(values[:2])), atol=1e-6)
    total = values[values > 1e-10].sum() if exact > n else values.sum()
    assert found[1].fit == pytest.approx(values[:2].sum() / total) and found[2].cumulative_ratio == pytest.approx(found[1].fit)
    assert got[np.abs(got[:, 0]).argmax(), 0] > 0


def test_principal_coordinates_of_few_ids(spark):
    none = spark.createDataFrame([], "a long, b long, distance double")
    for n in (0, 1):
        coordinates, axes = spectral.principal_coordinates(none, spark.range(n))
        assert coordinates.collect() == [] and axes.collect() == []
    coordinates, axes = spectral.principal_coordinates(none, spark.range(2))
    assert [round(r.eigenvalue, 9) for r in axes.collect()] == [0.5] and sorted(round(abs(r.coordinate), 6) for r in coordinates.collect()) == [0.5, 0.5]


def test_ratios_of_many_ids_are_of_the_positive_eigenvalues(spark):
    """Above 512 ids the trace stood for the sum, and the search took a job per product."""
    n = 560
    rng = np.random.default_rng(5)
    pairs = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.1]
    frame = spark.createDataFrame(pairs, "a long, b long, distance double")
    coordinates, axes = spectral.principal_coordinates(frame, spark.range(n), k=2)
    values, vectors = dense_scaling(n, pairs)
    found = {r.axis: r for r in axes.collect()}
    assert values[-1] < -0.1
    assert [found[i].explained_ratio for i in (1, 2)] == pytest.approx(values[:2] / values[values > 1e-10].sum(), rel=1e-8)
    got = np.zeros((n, 2))
    for r in coordinates.collect():
        got[r.id, r.axis - 1] = r.coordinate
    assert np.allclose(np.abs(got), np.abs(vectors[:, :2] * np.sqrt(values[:2])), atol=1e-7)


@pytest.mark.parametrize("exact", [512, 4])
def test_whole_ratios_do_not_depend_on_a_switch_by_size(spark, monkeypatch, exact):
    """Above ``EXACT_IDS`` the trace stood for the sum of the positive eigenvalues."""
    monkeypatch.setattr(spectral, "EXACT_IDS", exact)
    monkeypatch.setattr(spectral, "ROW_CELLS", 7)
    monkeypatch.setattr(spectral, "CELLS_AT_ONCE", 50)
    monkeypatch.setattr(spectral, "SPACE_VECTORS", 20)
    n, pairs = 60, distances(60)
    frame = spark.createDataFrame(pairs, "a long, b long, distance double")
    coordinates, axes = spectral.principal_coordinates(frame, spark.range(n), k=2, whole=True)
    values, vectors = dense_scaling(n, pairs)
    assert (values < -1e-3).sum() > 3
    found = {r.axis: r for r in axes.collect()}
    assert [found[i].explained_ratio for i in (1, 2)] == pytest.approx(values[:2] / values[values > 1e-10].sum(), rel=1e-6)
    got = np.zeros((n, 2))
    for r in coordinates.collect():
        got[r.id, r.axis - 1] = r.coordinate
    assert np.allclose(np.abs(got), np.abs(vectors[:, :2] * np.sqrt(values[:2])), atol=1e-5)


@pytest.mark.parametrize("exact", [512, 4])
def test_components_equal_a_dense_solver(spark, monkeypatch, exact):
    monkeypatch.setattr(spectral, "EXACT_IDS", exact)
    rng = np.random.default_rng(3)
    x = rng.random((60, 14)) < 0.3
    x[:, :4] |= rng.random((60, 1)) < 0.4
    x[:, 13] = True  # no variance
    rows = [(int(e), f"f{f}") for e, f in zip(*np.nonzero(x))]
    coordinates, components, loadings = spectral.principal_components(spark.createDataFrame(rows + rows[:5], "e long, f string"), "e", "f", k=3)
    z = (x[:, :13] - x[:, :13].mean(axis=0)) / x[:, :13].std(axis=0)
    values, axes = np.linalg.eigh(z.T @ z / len(z))
    assert [r.explained_ratio for r in components.orderBy("component").collect()] == pytest.approx(values[::-1][:3] / 13, rel=1e-6)
    got = np.zeros((60, 3))
    for r in coordinates.collect():
        got[r.e, r.component - 1] = r.coordinate
    assert np.allclose(np.abs(got), np.abs(z @ axes[:, ::-1][:, :3]), atol=1e-5)
    assert loadings.count() == 13 * 3
    assert spectral.principal_components(spark.createDataFrame([], "e long, f string"), "e", "f")[1].collect() == []


@pytest.mark.parametrize("block", [1024, 7])
def test_tile_sums_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK_SETS", block)
    monkeypatch.setattr(tiles, "COLUMNS_AT_ONCE", 3)
    rng = random.Random(4)
    sets = {e: frozenset(rng.sample("abcdefghij", rng.randint(1, 5))) for e in range(50)}
    group = {e: "xyz"[e % 3] if e else "alone" for e in sets}
    feats = spark.createDataFrame([(e, f) for e, fs in sets.items() for f in sorted(fs)], "e long, f string")
    groups = spark.createDataFrame(sorted(group.items()), "e long, g string")
    expected = {}
    for a in sets:
        for b in sets:
            if a < b:
                key = tuple(sorted((group[a], group[b])))
                expected[key] = expected.get(key, 0.0) + len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {(r.group_a, r.group_b): (r.sum_similarity, r.n_pairs) for r in si.group_matrix(feats, groups, "e", "f", "g").collect()}
    assert {k: v[0] for k, v in got.items() if v[1]} == pytest.approx(expected)
    marked, names = tiles.marked_sets(token_sets(feats, "e", "f"), groups, "e", "g")
    code = {r.g: r.code for r in names.collect()}
    of = {frozenset(r.tokens): r.signature for r in token_sets(feats, "e", "f").collect()}
    sums = {(r.sid, r.label): r.s for r in tiles.distance_sums(marked).collect()}
    for s in set(sets.values()):
        for g in code:
            assert sums[of[s], code[g]] == pytest.approx(sum(len(s ^ t) ** 0.5 for e, t in sets.items() if group[e] == g), abs=1e-9)


def test_ward_cuts_are_nested():
    rng = np.random.default_rng(1)
    centres = np.concatenate([rng.normal(size=(4, 2)) * 0.1 + c for c in ([0, 0], [5, 5], [0, 9])])
    cuts = si.ward_cuts(centres, np.ones(12), [3, 5, 7])
    assert cuts[3] == [0] * 4 + [1] * 4 + [2] * 4
    for fine, coarse in ((7, 5), (5, 3)):
        assert all(len({cuts[coarse][i] for i in range(12) if cuts[fine][i] == c}) == 1 for c in range(fine))


def test_permutation_batches_draw_what_the_joins_draw(spark, monkeypatch):
    x = spark.createDataFrame(distances(12, 1, 0.8), "a long, b long, distance double")
    y = spark.createDataFrame(distances(12, 2, 0.8), "a long, b long, distance double")
    ids = spark.range(12)
    members = spark.createDataFrame([(f"é{k}", k % 3, (k * 7) % 5 % 2) for k in range(15)], "e string, a long, b long")
    runs = []
    for dense in (1000, 0):
        monkeypatch.setattr(si, "DENSE_IDS", dense)
        monkeypatch.setattr(si, "DENSE_ENTITIES", dense)
        runs.append([si.mantel(x, y, ids, n=40, method=m).first() for m in ("spearman", "pearson")] + [si.mantel_membership(members, "e", "a", "b", n=40).first()])
    for one, two in zip(*runs):
        assert one.asDict() == pytest.approx(two.asDict())


def test_tasks_evaluate_thousands_of_ids(spark, monkeypatch):
    """Above 2,048 ids and pair by pair no row per iteration and pair is joined; the draws stay the same."""
    from annospan.operators import similarity as si

    ids = spark.range(2100).select("id")
    pairs = [(a, a + 1 + a % 5, (a * 7 % 10) / 10) for a in range(2000)]
    near = spark.createDataFrame(pairs, "a long, b long, distance double")
    other = spark.createDataFrame([(a, b, (a * 3 % 9) / 10) for a, b, _ in pairs], "a long, b long, distance double")
    joined = si._joined_products
    monkeypatch.setattr(si, "PAIRS_AT_ONCE", 300)
    monkeypatch.setattr(si, "_joined_products", None)
    in_tasks = si.mantel(near, other, ids, n=3).first()
    monkeypatch.setattr(si, "_joined_products", joined)
    monkeypatch.setattr(si, "DENSE_PAIRS", 1_999)
    by_join = si.mantel(near, other, ids, n=3).first()
    assert [round(x, 9) for x in in_tasks] == [round(x, 9) for x in by_join]


def test_tasks_evaluate_memberships_of_many_entities(spark, monkeypatch):
    """More than 200,000 entities are not copied once an iteration."""
    from annospan.operators import similarity as si

    monkeypatch.setattr(si, "_joined_memberships", None)
    rows = spark.range(200_100).selectExpr("id", "id % 7 AS x", "id % 3 AS y")
    assert si.mantel_membership(rows, "id", "x", "y", n=2).first().n_pairs == 200_100 * 200_099 // 2


def test_tasks_evaluate_memberships_of_millions_of_entities(spark, monkeypatch):
    """More than 2,000,000 entities were copied once an iteration."""
    from annospan.operators import similarity as si

    monkeypatch.setattr(si, "_joined_memberships", None)
    rows = spark.range(2_000_100).selectExpr("id", "id % 7 AS x", "id % 3 AS y")
    assert si.mantel_membership(rows, "id", "x", "y", n=2).first().n_pairs == 2_000_100 * 2_000_099 // 2


@pytest.mark.parametrize("cells", [40, 10_000])
def test_chunks_of_rows_meet_without_a_row_per_iteration(spark, monkeypatch, cells):
    """Beyond the limits of one task a row per iteration and pair was joined."""
    x = spark.createDataFrame(distances(25, 1, 0.8), "a long, b long, distance double")
    y = spark.createDataFrame(distances(25, 2, 0.8), "a long, b long, distance double")
    want = si.mantel(x, y, spark.range(25), n=30).first()
    monkeypatch.setattr(si, "DENSE_PAIRS", 0)
    monkeypatch.setattr(si, "CHUNK_CELLS", cells)
    monkeypatch.setattr(si, "HELD_CELLS", 60)
    monkeypatch.setattr(si, "permute", None, raising=False)
    assert si.mantel(x, y, spark.range(25), n=30).first().asDict() == pytest.approx(want.asDict())
