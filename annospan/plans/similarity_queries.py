"""Similarity, ordination, clustering and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.functions.stats import ERFC
from annospan.operators import similarity as si
from annospan.operators import spectral
from annospan.plans.base import query, table

SEED = 42


def buyers(spark, sf, other: str = "o_custkey"):
    """(brand, buyer or order) pairs."""
    line, part, orders = (table(spark, sf, t) for t in ("lineitem", "part", "orders"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if other == "o_custkey":
        joined = joined.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("p_brand").alias("brand"), F.col(other).alias("member")).distinct()


def order_types(spark, sf, feature: str = "p_type"):
    """(order, feature) pairs and the labels of the orders."""
    line, part, orders = (table(spark, sf, t) for t in ("lineitem", "part", "orders"))
    feats = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entity"), F.col(feature).alias("feature")).distinct()
    labels = orders.select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("status"))
    return feats, labels


def jaccard_sql(name: str, member: str, join: str = "") -> str:
    return f"""{name}d AS (SELECT DISTINCT p_brand AS brand, {member} AS member FROM lineitem JOIN part ON l_partkey = p_partkey {join}),
{name}n AS (SELECT brand, count(*) AS n FROM {name}d GROUP BY brand),
{name} AS (SELECT x.brand AS a, y.brand AS b, count(*) AS shared, any_value(nx.n) AS n_a, any_value(ny.n) AS n_b, count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS similarity
  FROM {name}d x JOIN {name}d y ON x.member = y.member AND x.brand < y.brand JOIN {name}n nx ON nx.brand = x.brand JOIN {name}n ny ON ny.brand = y.brand GROUP BY 1, 2)"""


BUYERS = jaccard_sql("ja", "o_custkey", "JOIN orders ON l_orderkey = o_orderkey")
ORDERS = jaccard_sql("jb", "l_orderkey")


@query("m09_pairwise_jaccard", f"WITH {BUYERS} SELECT a, b, shared, n_a, n_b, round(similarity, 6) AS similarity FROM ja")
def pairwise(spark, sf):
    return si.pairwise_jaccard(buyers(spark, sf), "brand", "member").withColumn("similarity", F.round("similarity", 6))


@query("k01_top_similar_pairs", """WITH d AS (SELECT DISTINCT o_custkey AS e, p_brand AS f FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT e, count(*) AS n FROM d GROUP BY e),
s AS (SELECT x.e AS a, y.e AS b, count(*) AS shared, count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS similarity
  FROM d x JOIN d y ON x.f = y.f AND x.e < y.e JOIN n nx ON nx.e = x.e JOIN n ny ON ny.e = y.e GROUP BY 1, 2 HAVING count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) >= 0.3),
t AS (SELECT * FROM s ORDER BY similarity DESC, a, b LIMIT 50)
SELECT t.a, t.b, any_value(shared) AS shared, any_value(similarity) AS similarity, any_value(pa.c_mktsegment) AS label_a, any_value(pb.c_mktsegment) AS label_b, any_value(pa.c_mktsegment = pb.c_mktsegment) AS same_cluster,
  array_to_string(list(x.f ORDER BY x.f)[1:5], ';') AS top_shared_features
FROM t JOIN customer pa ON pa.c_custkey = a JOIN customer pb ON pb.c_custkey = b JOIN d x ON x.e = t.a JOIN d y ON y.e = t.b AND y.f = x.f GROUP BY t.a, t.b""")
def top_similar(spark, sf):
    feats = buyers(spark, sf).select(F.col("member").alias("entity"), F.col("brand").alias("feature"))
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"))
    return si.top_pairs(feats, "entity", "feature", labels, "grp", n=50, min_sim=0.3)


@query("m10_cluster_distance", """SELECT x.c_custkey AS a, y.c_custkey AS b, CAST(0 AS INTEGER) AS distance FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_mktsegment = y.c_mktsegment AND x.c_custkey < y.c_custkey""")
def cluster_distance(spark, sf):
    clusters = table(spark, sf, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit("|"), "c_mktsegment").alias("cluster"))
    return si.cluster_distance(clusters, "c_custkey", "cluster")


SETS = """d AS (SELECT DISTINCT l_orderkey AS e, p_type AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
sets AS (SELECT e, list(f ORDER BY f) AS t FROM d GROUP BY e)"""
MATRIX = f"""{SETS}, m AS (SELECT t, o_orderpriority AS g, count(*) AS m FROM sets JOIN orders ON o_orderkey = e GROUP BY 1, 2),
p AS (SELECT least(x.g, y.g) AS group_a, greatest(x.g, y.g) AS group_b,
    CASE WHEN x.t = y.t AND x.g = y.g THEN x.m * (x.m - 1) / 2 WHEN x.t = y.t THEN x.m * y.m / 2 ELSE
    len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) * x.m * y.m / 2 END AS s FROM m x, m y),
sz AS (SELECT g, sum(m) AS n FROM m GROUP BY g),
mat AS (SELECT group_a, group_b, CAST(CASE WHEN group_a = group_b THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END AS BIGINT) AS n_pairs, sum(s) AS sum_similarity FROM p JOIN sz a ON a.g = group_a JOIN sz b ON b.g = group_b GROUP BY group_a, group_b, a.n, b.n)"""


def matrix(spark, sf):
    feats, labels = order_types(spark, sf)
    return si.group_matrix(feats, labels, "entity", "feature", "grp")


@query("m15_m17_group_matrix", f"WITH {MATRIX} SELECT group_a, group_b, n_pairs, round(sum_similarity, 4) AS sum_similarity, round(sum_similarity / n_pairs, 6) AS mean_similarity FROM mat")
def group_matrix(spark, sf):
    return matrix(spark, sf).withColumns({"sum_similarity": F.round("sum_similarity", 4), "mean_similarity": F.round("mean_similarity", 6)})


@query("m15_group_similarity", f"""WITH {MATRIX}, x AS (SELECT group_a AS grp, group_a, group_b, n_pairs, sum_similarity FROM mat UNION ALL SELECT group_b, group_a, group_b, n_pairs, sum_similarity FROM mat WHERE group_a <> group_b),
w AS (SELECT grp, round(sum(sum_similarity) FILTER (WHERE group_a = group_b) / sum(n_pairs) FILTER (WHERE group_a = group_b), 4) AS w, round(sum(sum_similarity) FILTER (WHERE group_a <> group_b) / sum(n_pairs) FILTER (WHERE group_a <> group_b), 4) AS b FROM x GROUP BY grp)
SELECT grp, CAST(n AS BIGINT) AS n_proteins, w AS within_mean_sim, b AS between_mean_sim, round(w / (b + 1e-9), 4) AS separation_ratio FROM w JOIN sz ON g = grp""")
def group_similarity(spark, sf):
    feats, labels = order_types(spark, sf)
    sizes = feats.select("entity").distinct().join(labels, "entity").groupBy("grp").agg(F.count(F.lit(1)).alias("n_proteins"))
    return si.group_similarity(matrix(spark, sf), sizes, "grp")


@query("m17_cluster_matrix", f"""WITH {MATRIX}, dom AS (SELECT o_orderpriority AS g, arg_min(o_orderstatus, (-n, o_orderstatus)) AS d FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)
SELECT group_a, group_b, n_pairs, round(sum_similarity / n_pairs, 6) AS mean_similarity, a.d AS dominant_a, b.d AS dominant_b FROM mat JOIN dom a ON a.g = group_a JOIN dom b ON b.g = group_b""")
def cluster_matrix(spark, sf):
    _, labels = order_types(spark, sf)
    out = si.cluster_matrix(matrix(spark, sf), labels, "entity", "grp", "status")
    return out.drop("sum_similarity").withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("m14_silhouette", f"""WITH {SETS}, m AS (SELECT t, o_orderstatus AS c, count(*) AS m FROM sets JOIN orders ON o_orderkey = e GROUP BY 1, 2),
sz AS (SELECT c, sum(m) AS n FROM m GROUP BY c),
dd AS (SELECT x.t, x.c AS own, x.m, y.c, sum(sqrt(len(x.t) + len(y.t) - 2 * len(list_intersect(x.t, y.t))) * y.m) AS s FROM m x, m y GROUP BY x.t, x.c, x.m, y.c),
ab AS (SELECT dd.t, own, any_value(m) AS m, max(CASE WHEN dd.c = own THEN s / (n - 1) END) AS a, min(CASE WHEN dd.c <> own THEN s / n END) AS b FROM dd JOIN sz USING (c) GROUP BY dd.t, own)
SELECT round(sum((b - a) / greatest(a, b) * m) / sum(m), 6) AS silhouette, CAST(sum(m) AS BIGINT) AS n FROM ab""")
def silhouette(spark, sf):
    feats, labels = order_types(spark, sf)
    return si.silhouette(feats, labels, "entity", "feature", "status").withColumn("silhouette", F.round("silhouette", 6))


@query("w09_average_rank", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS avg_rank FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_discount)""")
def average_rank(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    return si.avg_rank(line, "l_discount", F.floor(F.col("l_discount") * 20), ["l_returnflag"]).drop("l_discount")


POLY = "0"
for _c in reversed(ERFC):
    POLY = f"({POLY} * t + ({_c}))"


@query("m16_mann_whitney", f"""WITH v AS (SELECT l_quantity AS v, sum((l_returnflag = 'R')::INT)::DOUBLE AS nx, sum((l_returnflag <> 'R')::INT)::DOUBLE AS ny FROM lineitem GROUP BY 1),
r AS (SELECT *, sum(nx + ny) OVER (ORDER BY v) - (nx + ny) + (nx + ny + 1) / 2 AS rk FROM v),
s AS (SELECT sum(rk * nx) - sum(nx) * (sum(nx) + 1) / 2 AS u, sum(nx) AS nx, sum(ny) AS ny, sum((nx + ny) ** 3 - (nx + ny)) AS ties FROM r),
z AS (SELECT *, (u - nx * ny / 2 - 0.5) / sqrt(nx * ny / 12 * ((nx + ny + 1) - ties / ((nx + ny) * (nx + ny - 1)))) AS z FROM s),
p AS (SELECT *, abs(z / sqrt(2.0)) AS x, 1 / (1 + abs(z / sqrt(2.0)) * 0.5) AS t FROM z), q AS (SELECT *, t * exp(-x * x + {POLY}) AS tail FROM p)
SELECT u, CAST(nx AS BIGINT) AS n_x, CAST(ny AS BIGINT) AS n_y, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN tail ELSE 2 - tail END * 0.5, 6) AS p_value FROM q""")
def mann_whitney(spark, sf):
    line = table(spark, sf, "lineitem").select("l_quantity", "l_returnflag")
    out = si.mann_whitney(line, "l_quantity", F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 10))
    return out.withColumns({"z": F.round("z", 6), "p_value": F.round("p_value", 6)})


def brand_distances(spark, sf):
    """Two sparse distance tables of the brands (pairs that share nothing are at distance 1) and all brands."""
    tables = [
        si.pairwise_jaccard(d, "brand", "member").select("a", "b", (1 - F.col("similarity")).alias("distance"))
        for d in (buyers(spark, sf), buyers(spark, sf, "l_orderkey"))
    ]
    return *tables, table(spark, sf, "part").select(F.col("p_brand").alias("id")).distinct()


ALL_PAIRS = f"""{BUYERS}, {ORDERS}, ids AS (SELECT DISTINCT p_brand AS id FROM part),
p AS (SELECT x.id AS a, y.id AS b, 1 - coalesce(ja.similarity, 0) AS da, 1 - coalesce(jb.similarity, 0) AS db FROM ids x JOIN ids y ON x.id < y.id
  LEFT JOIN ja ON ja.a = x.id AND ja.b = y.id LEFT JOIN jb ON jb.a = x.id AND jb.b = y.id)"""
MANTEL = 9999


def suppliers(spark, sf):
    """Sparse distances of the suppliers by their parts, and all suppliers."""
    parts = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    near = si.pairwise_jaccard(parts, "l_suppkey", "l_partkey").select("a", "b", (1 - F.col("similarity")).alias("distance"))
    return near, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))


SUPPLIERS = """sd AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS f FROM lineitem), sn AS (SELECT e, count(*) AS n FROM sd GROUP BY e),
sj AS (SELECT x.e AS a, y.e AS b, 1 - count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS d FROM sd x JOIN sd y ON x.f = y.f AND x.e < y.e JOIN sn nx ON nx.e = x.e JOIN sn ny ON ny.e = y.e GROUP BY 1, 2)"""


def supplier_distances(spark, sf):
    """Two sparse distance tables of the suppliers, by their parts and by their customers, and all suppliers."""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    customers = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    other = si.pairwise_jaccard(customers, "l_suppkey", "o_custkey").select("a", "b", (1 - F.col("similarity")).alias("distance"))
    x, ids = suppliers(spark, sf)
    return x, other, ids


@query("m18_mantel_spearman", f"""WITH {SUPPLIERS},
cd AS (SELECT DISTINCT l_suppkey AS e, o_custkey AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey), cn AS (SELECT e, count(*) AS n FROM cd GROUP BY e),
cj AS (SELECT x.e AS a, y.e AS b, 1 - count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS d FROM cd x JOIN cd y ON x.f = y.f AND x.e < y.e JOIN cn nx ON nx.e = x.e JOIN cn ny ON ny.e = y.e GROUP BY 1, 2),
ids AS (SELECT s_suppkey AS id FROM supplier),
p AS (SELECT x.id AS a, y.id AS b, coalesce(sj.d, 1) AS da, coalesce(cj.d, 1) AS db FROM ids x JOIN ids y ON x.id < y.id LEFT JOIN sj ON sj.a = x.id AND sj.b = y.id LEFT JOIN cj ON cj.a = x.id AND cj.b = y.id),
k AS (SELECT a, b, rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2.0 AS x, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2.0 AS y FROM p),
it AS (SELECT unnest(range(1, {MANTEL + 1})) AS i),
f AS (SELECT id, row_number() OVER (ORDER BY md5('{SEED}|fixed|' || id || '|' || id), id) AS k FROM ids),
g AS (SELECT i, list(id ORDER BY md5('{SEED}|' || i || '|' || id || '|' || id), id) AS tos FROM ids, it GROUP BY i),
w AS (SELECT list(row ORDER BY a) AS m FROM (SELECT x.id AS a, list(coalesce(k.y, 0) ORDER BY y.id) AS row FROM ids x CROSS JOIN ids y LEFT JOIN k ON k.a = least(x.id, y.id) AND k.b = greatest(x.id, y.id) GROUP BY x.id)),
g2 AS (SELECT i, list_transform(tos, lambda t: list_position(every, t)) AS pos FROM g, (SELECT list(id ORDER BY id) AS every FROM ids)),
u AS (SELECT list({{'x': k.x, 'a': fa.k, 'b': fb.k}}) AS us FROM k JOIN f fa ON fa.id = k.a JOIN f fb ON fb.id = k.b),
n AS (SELECT i, (cnt * list_sum(list_transform(us, lambda e: e.x * m[pos[e.a]][pos[e.b]])) - sx * sy) / sqrt((cnt * sxx - sx * sx) * (cnt * syy - sy * sy)) AS r
  FROM g2, u, w, (SELECT count(*)::DOUBLE AS cnt, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy FROM k)),
o AS (SELECT corr(x, y) AS r, count(*) AS n_pairs FROM k)
SELECT round(any_value(o.r), 6) AS r, (count(*) FILTER (WHERE abs(n.r) >= abs(o.r)) + 1) / {MANTEL + 1} AS p_value, round(avg(n.r), 6) AS null_mean, round(stddev_pop(n.r), 6) AS null_std, any_value(n_pairs) AS n_pairs FROM n, o""")
def mantel(spark, sf):
    out = si.mantel(*supplier_distances(spark, sf), n=MANTEL)
    return out.withColumns({c: F.round(c, 6) for c in ("r", "null_mean", "null_std")})


def same_pair_sql(counts: str, by: str) -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    u = f"USING ({by})" if by else "ON TRUE"
    return f"""(SELECT {b} (m * s11 - s1 * s2) / sqrt(s1 * (m - s1) * s2 * (m - s2)) AS r, m FROM (SELECT {b} sum(n * (n - 1) / 2) AS s11, sum(n) * (sum(n) - 1) / 2 AS m FROM {counts} {g})
      JOIN (SELECT {b} sum(n * (n - 1) / 2) AS s1 FROM (SELECT {b} a, sum(n) AS n FROM {counts} GROUP BY {b} a) {g}) {u} JOIN (SELECT {b} sum(n * (n - 1) / 2) AS s2 FROM (SELECT {b} b, sum(n) AS n FROM {counts} GROUP BY {b} b) {g}) {u})"""


@query("m18_mantel_membership", f"""WITH c AS (SELECT c_custkey AS e, c_nationkey AS a, c_mktsegment AS b FROM customer), it AS (SELECT unnest(range(1, {MANTEL + 1})) AS i),
f AS (SELECT i, a, row_number() OVER (PARTITION BY i ORDER BY md5('{SEED}|fixed|' || e) || e) AS k FROM c, it), g AS (SELECT i, b, row_number() OVER (PARTITION BY i ORDER BY md5('{SEED}|' || i || '|' || e) || e) AS k FROM c, it),
cn AS (SELECT i, a, b, count(*) AS n FROM f JOIN g USING (i, k) GROUP BY 1, 2, 3), co AS (SELECT a, b, count(*) AS n FROM c GROUP BY 1, 2),
n AS (SELECT i, r FROM {same_pair_sql('cn', 'i')}), o AS (SELECT r, m FROM {same_pair_sql('co', '')})
SELECT round(any_value(o.r), 7) AS r, (count(*) FILTER (WHERE abs(n.r) >= abs(o.r)) + 1) / {MANTEL + 1} AS p_value, round(avg(n.r), 7) AS null_mean, round(stddev_pop(n.r), 7) AS null_std, CAST(any_value(o.m) AS BIGINT) AS n_pairs FROM n, o""")
def mantel_membership(spark, sf):
    out = si.mantel_membership(table(spark, sf, "customer"), "c_custkey", "c_nationkey", "c_mktsegment", n=MANTEL)
    return out.withColumns({c: F.round(c, 7) for c in ("r", "null_mean", "null_std")})


@query("m19_cluster_agreement", """WITH c AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s11, (SELECT sum(na * (na - 1) / 2) FROM ra) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM rb) AS sb, t * (t - 1) / 2 AS m, t,
  (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT -sum(na / t * ln(na / t)) FROM ra, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM rb, t) AS hb FROM t)
SELECT round((s11 - sa * sb / m) / ((sa + sb) / 2 - sa * sb / m), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, CAST(t AS BIGINT) AS n_proteins, (SELECT count(*) FROM ra) AS n_clusters_a, (SELECT count(*) FROM rb) AS n_clusters_b FROM s""")
def cluster_agreement(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    return si.cluster_agreement(emb, "a", "b")


def squared_sql(m: str) -> str:
    """Square of a symmetric matrix of nested lists."""
    return f"list_transform({m}, lambda ra: list_transform({m}, lambda rb: list_dot_product(ra, rb)))"


def inner_sql(a: str, b: str) -> str:
    """Sum of the products of the entries of two matrices."""
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: list_dot_product({a}[i], {b}[i])))"


def projectors_sql(matrix: str, k: int, steps: int = 40) -> str:
    """p1..pk of a positive semi-definite matrix (table ``matrix``, column x): l, the largest eigenvalue, and p, the projector on its vector.

    The matrix is squared until only its largest eigenvalue is left, then taken out for the next one.
    """
    parts, now = [], matrix
    for i in range(1, k + 1):
        parts.append(f"""r{i} AS (SELECT 0 AS t, x FROM {now} UNION ALL
  SELECT t + 1, list_transform(y, lambda r: list_transform(r, lambda v: v / tr)) FROM (SELECT t, y, list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i][i])) AS tr FROM (SELECT t, {squared_sql('x')} AS y FROM r{i} WHERE t < {steps}))),
p{i} AS (SELECT z.x AS p, {inner_sql('m.x', 'z.x')} AS l FROM r{i} z, {now} m WHERE z.t = {steps}),
d{i} AS (SELECT list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) + 1), lambda j: x[i][j] - l * p[i][j])) AS x FROM {now}, p{i})""")
        now = f"d{i}"
    return ",\n".join(parts)


COMPONENTS = 5


@query("m11_w10_pca", f"""WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS e, p_type AS f FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT count(DISTINCT e)::DOUBLE AS n FROM d), s AS (SELECT f, count(*) / n AS mu, sqrt(count(*) / n * (1 - count(*) / n)) AS sd FROM d, n GROUP BY f, n HAVING count(*) < n),
c AS (SELECT x.f AS a, y.f AS b, count(*)::DOUBLE AS c FROM d x JOIN d y USING (e) GROUP BY 1, 2),
z AS (SELECT a.f AS a, list((coalesce(c.c, 0) / n - a.mu * b.mu) / (a.sd * b.sd) ORDER BY b.f) AS row FROM s a CROSS JOIN s b CROSS JOIN n LEFT JOIN c ON c.a = a.f AND c.b = b.f GROUP BY a.f),
m0 AS (SELECT list(row ORDER BY a) AS x FROM z), {projectors_sql('m0', COMPONENTS)},
l AS ({' UNION ALL '.join(f'SELECT {i} AS component, l / len(p) AS r FROM p{i}' for i in range(1, COMPONENTS + 1))})
SELECT component, round(r, 6) AS explained_ratio, round(sum(r) OVER (ORDER BY component), 6) AS cumulative_ratio FROM l""")
def pca(spark, sf):
    feats = order_types(spark, sf)[0]
    components = spectral.principal_components(feats, "entity", "feature", COMPONENTS)[1]
    return components.withColumns({c: F.round(c, 6) for c in ("explained_ratio", "cumulative_ratio")})


@query("m12_principal_coordinates", f"""WITH RECURSIVE {SUPPLIERS},
sq AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b, CASE WHEN x.s_suppkey = y.s_suppkey THEN 0 ELSE coalesce(d, 1) ** 2 END AS v FROM supplier x CROSS JOIN supplier y
  LEFT JOIN sj ON sj.a = least(x.s_suppkey, y.s_suppkey) AND sj.b = greatest(x.s_suppkey, y.s_suppkey)),
mn AS (SELECT a AS id, avg(v) AS m FROM sq GROUP BY a), gm AS (SELECT avg(m) AS g FROM mn),
cells AS (SELECT a, b, -0.5 * (v - x.m - y.m + g) AS v FROM sq JOIN mn x ON x.id = a JOIN mn y ON y.id = b, gm),
size AS (SELECT sqrt(sum(v * v)) AS c, sum(v) FILTER (WHERE a = b) AS trace FROM cells),
bm AS (SELECT list(row ORDER BY a) AS x FROM (SELECT a, list(v ORDER BY b) AS row FROM cells GROUP BY a)),
sg AS (SELECT 0 AS t, list_transform(x, lambda r: list_transform(r, lambda v: v / c)) AS x FROM bm, size UNION ALL
  SELECT t + 1, list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) + 1), lambda j: 1.5 * x[i][j] - 0.5 * list_dot_product(y[i], x[j]))) FROM (SELECT t, x, {squared_sql('x')} AS y FROM sg WHERE t < 36)),
total AS (SELECT (trace + {inner_sql('bm.x', 'sg.x')}) / 2 AS s FROM bm, sg, size WHERE sg.t = 36),
m0 AS (SELECT list_transform(range(1, len(x) + 1), lambda i: list_transform(range(1, len(x) + 1), lambda j: x[i][j] + CASE WHEN i = j THEN c ELSE 0 END)) AS x FROM bm, size),
{projectors_sql('m0', 2)}, ids AS (SELECT list(s_suppkey ORDER BY s_suppkey) AS ids FROM supplier),
ax AS (SELECT 1 AS axis, l - c AS l, p FROM p1, size UNION ALL SELECT 2, l - c, p FROM p2, size),
u AS (SELECT axis, l, l / s AS r, sum(l / s) OVER () AS fit, unnest(ids) AS id, unnest(list_transform(range(1, len(p) + 1), lambda i: sqrt(greatest(l * p[i][i], 0)))) AS z FROM ax, total, ids)
SELECT id, axis, round(l, 6) AS eigenvalue, round(r, 6) AS explained_ratio, round(fit, 6) AS fit, round(z, 5) AS magnitude FROM u""")
def principal_coordinates(spark, sf):
    coordinates, axes = spectral.principal_coordinates(*suppliers(spark, sf), k=2, whole=True)
    return coordinates.join(axes, "axis").select(
        "id", "axis", *[F.round(c, 6).alias(c) for c in ("eigenvalue", "explained_ratio", "fit")], F.round(F.abs("coordinate"), 5).alias("magnitude")
    )


@query("m12_centred_distances", f"""WITH {ALL_PAIRS}, sq AS (SELECT a, b, da * da AS d FROM p UNION ALL SELECT b, a, da * da FROM p UNION ALL SELECT id, id, 0 FROM ids),
m AS (SELECT a AS id, avg(d) AS m FROM sq GROUP BY a), g AS (SELECT avg(m) AS g FROM m)
SELECT sq.a, sq.b, round(-0.5 * (d - x.m - y.m + g), 8) AS value FROM sq JOIN m x ON x.id = sq.a JOIN m y ON y.id = sq.b, g WHERE sq.a = sq.b OR sq.a < sq.b AND d < 1""")
def centred_distances(spark, sf):
    x, _, ids = brand_distances(spark, sf)
    return si.double_centred(x, ids)[0].withColumn("value", F.round("value", 8))


@query("m13_cluster_selection")
def cluster_selection(spark, sf):
    feats = order_types(spark, sf)[0]
    return si.cluster(feats, "entity", "feature")[1]
