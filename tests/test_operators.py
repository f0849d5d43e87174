"""Operators that SQL cannot restate, against brute force on small data."""

import itertools
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from annospan.functions import stats
from annospan.functions.text_similarity import char_tokens
from annospan.operators import blocks, compare, enrichment as en, similarity as si, summaries, transfer, vocab


def test_hypergeometric_tail(spark):
    rows = [(k, n, g, d) for n, g, d in [(200, 50, 30), (1000, 10, 990), (19923, 40, 142), (20, 20, 5), (50, 0, 5)] for k in (0, 1, 2, 5, 9, 12, 30) if k <= d]
    df = spark.createDataFrame(rows, "k long, t long, g long, d long")
    for r in stats.with_hypergeom_tail(df, "p", *[F.col(c) for c in "ktgd"]).collect():
        want = sum(math.comb(r.g, i) * math.comb(r.t - r.g, r.d - i) for i in range(max(r.k, 0, r.d + r.g - r.t), min(r.g, r.d) + 1)) / math.comb(r.t, r.d)
        assert r.p == pytest.approx(want, rel=1e-8, abs=1e-12)


def test_erfc(spark):
    for r in spark.createDataFrame([(x / 4,) for x in range(-12, 20)], "x double").withColumn("y", stats.erfc(F.col("x"))).collect():
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-6)


def sets(n, seed=3):
    rng = random.Random(seed)
    return {f"e{i:03d}": frozenset(rng.sample("abcdefgh", rng.randint(1, 5))) for i in range(n)}


@pytest.mark.parametrize("block", [2, 7, 256])
def test_co_members_meet_once(spark, block):
    data = sets(60)
    df = spark.createDataFrame([(f, e) for e, s in data.items() for f in s], "f string, e string")
    got = sorted((r.f, r.a.e, r.b.e) for r in blocks.co_members(df, "f", "e", block=block).collect())
    want = sorted((f, a, b) for a, b in itertools.combinations(sorted(data), 2) for f in data[a] & data[b])
    assert got == want


@pytest.mark.parametrize("block, task_pairs", [(2, 1), (7, 50), (1024, 10**9)])
def test_member_pairs_meet_once(spark, block, task_pairs):
    data = sets(60)
    rows = [(f, e) for e, s in data.items() for f in s] + [(None, "e001"), (None, "e002"), ("a", None)]
    df = spark.createDataFrame(rows, "f string, e string")
    got = sorted((r.a, r.b) for r in blocks.member_pairs(df, "f", "e", block, task_pairs).collect())
    assert got == sorted((a, b) for a, b in itertools.combinations(sorted(data), 2) for _ in data[a] & data[b])


def test_tasks_of_cluster_pairs_follow_the_pairs(spark):
    """5,000 ids are one small partition, but two million pairs; a null is no cluster of its own."""
    from annospan.operators import similarity as si

    df = spark.range(5000).selectExpr("id", "if(id % 100 = 0, null, id % 5) AS c")
    out = si.cluster_distance(df, "id", "c")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = [sum(1 for i in range(5000) if i % 100 and i % 5 == c) for c in range(5)]
    assert out.count() == sum(n * (n - 1) // 2 for n in sizes) and out.filter("a >= b OR distance <> 0").count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_is_exact(spark, threshold):
    data = sets(80)
    df = spark.createDataFrame([(e, f) for e, s in data.items() for f in s], "e string, f string")
    got = sorted((r.a, r.b, round(r.similarity, 6)) for r in si.similar_pairs(df, "e", "f", threshold, block=8).collect())
    j = lambda a, b: len(data[a] & data[b]) / len(data[a] | data[b])
    want = sorted((a, b, round(j(a, b), 6)) for a, b in itertools.combinations(sorted(data), 2) if j(a, b) >= threshold - 1e-12)
    assert got == want


def test_group_matrix_and_silhouette_match_brute_force(spark):
    data = sets(50, 9)
    label = {e: "xyz"[i % 3] for i, e in enumerate(sorted(data))}
    feats = spark.createDataFrame([(e, f) for e, s in data.items() for f in s], "e string, f string")
    groups = spark.createDataFrame(list(label.items()), "e string, g string")
    got = {(r.group_a, r.group_b): (r.n_pairs, r.sum_similarity) for r in si.group_matrix(feats, groups, "e", "f", "g", block=5).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(data), 2):
        k = tuple(sorted((label[a], label[b])))
        n, s = want.get(k, (0, 0.0))
        want[k] = (n + 1, s + len(data[a] & data[b]) / len(data[a] | data[b]))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])
    dist = lambda a, b: math.sqrt(len(data[a] ^ data[b]))
    scores = []
    for e in data:
        mean = lambda g: sum(dist(e, o) for o in data if o != e and label[o] == g) / sum(1 for o in data if o != e and label[o] == g)
        a, b = mean(label[e]), min(mean(g) for g in "xyz" if g != label[e])
        scores.append((b - a) / max(a, b))
    assert si.silhouette(feats, groups, "e", "f", "g", block=5).head()["silhouette"] == pytest.approx(sum(scores) / len(scores))


def symbols(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ABCD") for _ in range(rng.randint(2, 5))) + rng.choice(["", "1", "12"]) for _ in range(n)]


def similarity(a, b):
    a, b = a.upper(), b.upper()
    if a == b:
        return 1.0
    sa, sb = a.rstrip("0123456789"), b.rstrip("0123456789")
    return 0.9 if sa == sb and sa else round(SequenceMatcher(None, a, b).ratio(), 4)


def test_candidate_pairs_match_full_product(spark):
    rng = random.Random(5)
    side = lambda tag, seed: [(f"{tag}{i}", g, rng.choice(["k", "m", "other"]), rng.randint(10, 90), rng.choice(["c1", "c2", None])) for i, g in enumerate(symbols(25, seed))]
    left, right = side("h", 1), side("m", 2)
    schema = "accession string, gene string, grp string, length int, cluster string"
    got = {(r.a_accession, r.b_accession): (round(r.candidate_score, 6), r.confidence_tier) for r in transfer.score_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    want = {}
    for a in left:
        for b in right:
            same, grp = a[4] is not None and a[4] == b[4], a[2] == b[2] and a[2] != "other"
            sim = similarity(a[1], b[1])
            score = 3 * same + 2.5 * sim + grp + 0.5 * min(a[3], b[3]) / max(a[3], b[3])
            if score >= 1.0:
                tier = "high_confidence" if same and (sim == 1 or grp) else "probable" if same or sim == 1 else "possible" if grp and sim >= 0.7 else "low_confidence"
                want[a[0], b[0]] = (round(score, 6), tier)
    assert got == want


def test_closest_term_matches_full_product(spark):
    words, terms = symbols(30, 7), sorted(set(symbols(20, 8)))
    index = spark.createDataFrame([("t", w, w, w) for w in terms], "term_type string, form string, id string, id_label string")
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "token string")
    got = {r.token: (r.closest, r.ratio) for r in vocab.closest_terms(df, index, "token", 0.6).collect()}
    want = {}
    for w in set(words):
        best = max(((SequenceMatcher(None, w.lower(), t.lower()).ratio(), t.lower()) for t in terms), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if best[0] >= 0.6:
            want[w] = round(best[0], 4)
    assert {k: v[1] for k, v in got.items()} == want


def test_character_tokens_bound_the_ratio(spark):
    pairs = list(zip(symbols(40, 1), symbols(40, 2)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.size(F.array_intersect(char_tokens(F.col("a")), char_tokens(F.col("b")))).alias("o"))
    assert all(2 * r.o / (len(r.a) + len(r.b)) >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-12 for r in df.collect())


def test_bh_with_ties_and_families(spark):
    rng = random.Random(1)
    rows = [(i, f"f{i % 2}", rng.choice([0.0, 1e-9, 0.001, 0.02, 0.02, 0.3, 1.0, rng.random()])) for i in range(60)]
    got = {r.i: r.fdr for r in en.bh_fdr(spark.createDataFrame(rows, "i int, fam string, p double"), "p", ["fam"]).collect()}
    for fam in ("f0", "f1"):
        own = sorted((p, i) for i, f, p in rows if f == fam)
        low = 1.0
        for rank in range(len(own), 0, -1):
            low = min(low, own[rank - 1][0] * len(own) / rank)
            assert got[own[rank - 1][1]] == pytest.approx(low)


def test_permutation_keeps_margins(spark):
    pairs = spark.createDataFrame([(f"e{i % 7}", f"f{i % 5}") for i in range(35)], "e string, f string").distinct()
    out = en.permute(pairs, "e", "f", 3, 1)
    for col in ("e", "f"):
        want = sorted((r[0], r[1]) for r in pairs.groupBy(col).count().collect())
        for it in (1, 2, 3):
            assert sorted((r[0], r[1]) for r in out.filter(F.col("iteration") == it).groupBy(col).count().collect()) == want


def test_split_is_a_partition(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 31 else "c") for i in range(50)], "id int, tier string")
    counts = {(r.tier, r.split): r["count"] for r in transfer.stratified_split(df, "tier", F.col("id")).groupBy("tier", "split").count().collect()}
    assert counts == {("a", "test"): 6, ("a", "calibration"): 24, ("b", "calibration"): 1, ("c", "test"): 4, ("c", "calibration"): 15}


def test_injection_is_idempotent(spark):
    v = spark.createDataFrame([("t", "DOP:000001", "Near Helix"), ("t", "DOP:000002", "Far")], "term_type string, ID string, Name string")
    df = spark.createDataFrame([(1, "near helix;odd"), (2, None), (3, "Far")], "k int, c string")
    once, unmapped = vocab.inject_ids(df, v, {"c": "t"}, "k")
    twice, _ = vocab.inject_ids(once, v, {"c": "t"}, "k")
    want = [(1, "DOP:000001 Near Helix;odd"), (2, None), (3, "DOP:000002 Far")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    assert [r.token for r in unmapped.collect()] == ["odd"]


def test_empty_set_conventions(spark):
    a, e = F.array(F.lit("x")), F.array().cast("array<string>")
    r = spark.range(1).select(compare.jaccard(e, e).alias("a"), compare.jaccard(e, e, 1.0).alias("b"), compare.overlap_coeff(a, a).alias("c")).head()
    assert (r.a, r.b, r.c) == (0.0, 1.0, 1.0)


def sparse_distances(seed, n=9):
    rng = random.Random(seed)
    return {(f"i{a}", f"i{b}"): rng.choice([0.2, 0.4, rng.random(), 1.0, 1.0]) for a, b in itertools.combinations(range(n), 2)}


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_mantel_counts_pairs_that_are_not_in_the_tables(spark, method):
    tables = [sparse_distances(2), sparse_distances(5)]
    near = [spark.createDataFrame([(a, b, d) for (a, b), d in t.items() if d < 1], "a string, b string, distance double") for t in tables]
    ids = spark.createDataFrame([(f"i{k}",) for k in range(9)], "id string")
    r = si.mantel(*near, ids, n=49, method=method).head()
    x, y = ([t[k] for k in sorted(tables[0])] for t in tables)
    assert r.r == pytest.approx(pearson(ranks(x), ranks(y)) if method == "spearman" else pearson(x, y)) and r.n_pairs == 36
    same = si.mantel(near[0], near[0], ids, n=49, method=method).head()
    assert same.r == pytest.approx(1.0) and same.p_value <= 0.1


def test_double_centring_of_a_sparse_table(spark):
    full = sparse_distances(3)
    ids = [f"i{k}" for k in range(9)]
    d2 = {(a, b): 0.0 if a == b else full[min(a, b), max(a, b)] ** 2 for a in ids for b in ids}
    mean = {a: sum(d2[a, b] for b in ids) / 9 for a in ids}
    grand = sum(mean.values()) / 9
    near = spark.createDataFrame([(a, b, d) for (a, b), d in full.items() if d < 1], "a string, b string, distance double")
    cells, means = si.double_centred(near, spark.createDataFrame([(i,) for i in ids], "id string"))
    got = {(r.a, r.b): r.value for r in cells.collect()}
    assert set(got) == {k for k, d in full.items() if d < 1} | {(i, i) for i in ids}
    assert all(v == pytest.approx(-0.5 * (d2[k] - mean[k[0]] - mean[k[1]] + grand)) for k, v in got.items())
    assert {r.id: r.mean_square for r in means.collect()} == pytest.approx(mean)


@pytest.mark.parametrize("n", [3, 40, 400])
def test_best_pairs_are_the_best_of_all(spark, n):
    data = sets(40, 4)
    df = spark.createDataFrame([(e, f) for e, s in data.items() for f in s], "e string, f string")
    j = lambda a, b: len(data[a] & data[b]) / len(data[a] | data[b])
    ranked = sorted((-j(a, b), a, b) for a, b in itertools.combinations(sorted(data), 2) if j(a, b) >= 0.3)[:n]
    assert sorted((r.a, r.b) for r in si.best_pairs(df, "e", "f", n, 0.3).collect()) == sorted((a, b) for _, a, b in ranked)


def test_cooccurrence_of_a_hot_entity(spark):
    df = spark.createDataFrame([("HOT", f"t{i:02d}") for i in range(40)] + [("x", "t00"), ("x", "t01")], "e string, f string")
    rows = summaries.cooccurrence(df, "e", "f", block=6).collect()
    assert len(rows) == 780 and {(r.domain_a, r.domain_b): r.protein_count for r in rows}["t00", "t01"] == 2


def test_landing_updates_forces_and_compacts(spark, tmp_path):
    from annospan.streaming import landing

    schema, key = "k bigint, name string, v string", ["k"]
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    for rows in ([(1, "a", None), (2, "b", "x")], [(1, "a", "later"), (3, " ", None)]):
        write(rows)
        landing.land(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/progress", key, ["name"])
    now = landing.current(spark, f"{tmp_path}/out", key, ["name"])
    assert sorted((r.k, r.v) for r in now.collect()) == [(1, "later"), (2, "x"), (3, None)]
    landing.compact(spark, f"{tmp_path}/out", f"{tmp_path}/one", key, ["name"])
    assert spark.read.parquet(f"{tmp_path}/one").count() == 3
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "k bigint")
    assert sorted(r.k for r in landing.unprocessed(keys, now, "k", "name").collect()) == [3, 4]
    assert landing.unprocessed(keys, now, "k", "name", force=True).count() == 4


def test_empty_key_list_is_an_error(spark, tmp_path):
    from annospan.sources.tables import read_keys

    (tmp_path / "keys.txt").write_text("# nothing\n\n")
    with pytest.raises(ValueError):
        read_keys(spark, str(tmp_path / "keys.txt"))


def test_regions_from_a_list(spark):
    from annospan.sources.regions import filter_regions

    cells = ["[{'start': 3, 'end': 9, 'desc': 'Linker'}, {\"begin\": \"20\", \"to\": 30, \"description\": \"Disordered\"}, {'start': 4}]", "1) 5-8 | desc=a", "", None, "[oops"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, regions_pretty string")
    got = [(r.regions_filtered_pretty, r.region_remained_count) for r in filter_regions(df).orderBy("i").collect()]
    assert got[0] == ("1) 3-9 | len=7 | desc=Linker", 1) and got[1] == ("1) 5-8 | len=4 | desc=a", 1) and [n for _, n in got[2:]] == [0, 0, 0]


def test_entailment_that_does_not_settle_is_an_error(spark):
    from annospan.operators import triples

    schema = spark.createDataFrame([(f"p{i}", "owl:inverseOf", f"p{i + 1}", "iri") for i in range(8)], "s string, p string, o string, o_type string")
    data = spark.createDataFrame([("a", "p0", "b", "iri")], schema.schema)
    with pytest.raises(ValueError):
        triples.entail(data, schema, max_iter=1)


def test_cluster_labels_cover_all_entities(spark):
    df = spark.createDataFrame([(f"e{i}", f"{'abc'[i % 3]}{j}") for i in range(30) for j in range(3)], "e string, f string")
    labels, scores = si.cluster(df, "e", "f", k_max=4)
    assert labels.count() == 30 and scores.filter("chosen").head()["silhouette"] > 0.9


def brute_silhouette(points, labels):
    """Mean silhouette by Euclidean distances; 0 for a cluster of one."""
    total = 0.0
    for i, p in enumerate(points):
        by = {}
        for j, q in enumerate(points):
            if i != j:
                by.setdefault(labels[j], []).append(len(p ^ q) ** 0.5)
        own = by.pop(labels[i], None)
        if own and by:
            a, b = sum(own) / len(own), min(sum(d) / len(d) for d in by.values())
            total += (b - a) / max(a, b) if max(a, b) else 0.0
    return total / len(points)


def test_cluster_selection_searches_up_to_twelve(spark, monkeypatch):
    from annospan.plans import similarity_queries as sq

    rng = random.Random(8)
    sets = {e: frozenset(f"{e % 9}x{i}" for i in range(6) if rng.random() < 0.9) | {f"{e % 9}y"} for e in range(54)}
    feats = spark.createDataFrame([(e, f) for e, fs in sets.items() for f in sorted(fs)], "entity long, feature string")
    monkeypatch.setattr(sq, "order_types", lambda spark, sf: (feats, None))
    got = {r.k: (r.silhouette, r.chosen) for r in sq.cluster_selection(spark, "").collect()}
    assert sorted(got) == list(range(3, 13))
    best = max(got, key=lambda k: got[k][0])
    assert best > 6 and [k for k, (_, chosen) in got.items() if chosen] == [best]
    for k in (3, best):
        labels = {r.entity: r.cluster for r in si.cluster(feats, "entity", "feature", k=k)[0].collect()}
        assert got[k][0] == pytest.approx(brute_silhouette([sets[e] for e in sorted(sets)], [labels[e] for e in sorted(sets)]))


def test_what_follows_from_the_schema_is_written_before_it_meets_statements(spark, monkeypatch):
    """A table of unknown size would have all statements shuffled by their property, most of them into a few tasks."""
    from annospan.operators import triples

    written, write = [], triples.materialise
    monkeypatch.setattr(triples, "materialise", lambda df, name: written.append(name) or write(df, name))
    data = spark.createDataFrame([("a", "core:hasDomainType", "b", "iri")], "s string, p string, o string, o_type string")
    report = {r.measure: r.n for r in triples.entail(data, triples.triples_schema(spark))[2].collect()}
    assert {"reach", "entailed", "domains", "ranges", "superclasses"} <= set(written)
    assert report["asserted"] == 1 and report["total"] == 1 + report["inferred"]


def test_reasons_of_tokens_are_found_once_and_rows_meet_the_bad_ones_only(spark, monkeypatch):
    from annospan.operators import rules

    kept, write = [], rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df, name: kept.append(write(df, name)) or kept[-1])
    tokens = [(str(i), "position", t) for i, t in enumerate(["Cterminal", "DOF:1 x", "new", "new", "DOP:000009", "DOF:1 x"])]
    tokens = spark.createDataFrame(tokens, "row_id string, term_type string, token string")
    index = spark.createDataFrame([("position", "Cterminal")], "term_type string, form string")
    got = sorted(map(tuple, rules.outside_vocabulary(tokens, index, "row_id", "DOP").collect()))
    assert got == [("1", "wrong namespace: DOF:1 x"), ("2", "unrecognised: new"), ("3", "unrecognised: new"), ("5", "wrong namespace: DOF:1 x")]
    assert [t.count() for t in kept] == [2]
