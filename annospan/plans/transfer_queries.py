"""Annotation transfer: customers as sources and targets of purchased features."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.operators import transfer as tr
from annospan.operators.common import union_all
from annospan.plans.base import query, table, text

SEED = 42
CATEGORIES = ["domain_type", "function", "topology"]


def customer_lines(spark, sf):
    line, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("o_custkey").alias("entity"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
        F.concat_ws("-", "l_returnflag", "l_linestatus", F.split("p_name", " ")[1]).alias("use"), F.col("l_linenumber").alias("line"),
    )


def annotations(spark, sf):
    """(entity, annotation_category, term_value) of the purchases of a customer."""
    cats = F.array(*[
        F.struct(F.lit(k).alias("annotation_category"), F.col(c).alias("term_value")) for k, c in zip(CATEGORIES, ("brand", "use", "type"))
    ])
    return customer_lines(spark, sf).select("entity", F.explode(cats).alias("c")).select("entity", "c.*").distinct()


def pairs(spark, sf):
    """Customer k is paired with a customer of the other half."""
    n = table(spark, sf, "customer").agg((F.count(F.lit(1)) / 2).cast("int").alias("h"))
    half = n.scalar()
    return table(spark, sf, "customer").filter(F.col("c_custkey") < half).select(
        F.col("c_custkey").alias("source"), (half + F.col("c_custkey") * 7 % half).cast("long").alias("target"), "c_mktsegment", "c_nationkey"
    )


def sides(spark, sf):
    """(source annotations, gold of the targets)."""
    ann = annotations(spark, sf)
    half = table(spark, sf, "customer").agg((F.count(F.lit(1)) / 2).cast("int").alias("h")).scalar()
    source = ann.filter(F.col("entity") < half).withColumnRenamed("entity", "source")
    gold = ann.filter(F.col("entity") >= half).select(F.col("entity").alias("target"), F.col("annotation_category").alias("category"), "term_value")
    return source, gold


def mean_sql(column: str) -> str:
    """Mean of values of four decimals: whole units are added up and rounded once."""
    return f"floor((2 * sum(round({column} * 10000)::BIGINT) + count(*)) / (2 * count(*))) / 10000 AS {column}"


MEANS = ", ".join(mean_sql(c) for c in ("precision", "recall", "f1", "jaccard"))

ANN = """half AS (SELECT CAST(count(*) // 2 AS BIGINT) AS h FROM customer),
cl AS (SELECT o_custkey AS entity, p_brand AS brand, p_type AS type, l_returnflag || '-' || l_linestatus || '-' || split_part(p_name, ' ', 2) AS use, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ann AS (SELECT DISTINCT entity, 'domain_type' AS category, brand AS term_value FROM cl UNION ALL SELECT DISTINCT entity, 'function', use FROM cl UNION ALL SELECT DISTINCT entity, 'topology', type FROM cl),
prs AS (SELECT c_custkey AS source, h + c_custkey * 7 % h AS target, c_mktsegment, c_nationkey FROM customer, half WHERE c_custkey < (SELECT h FROM half)),
src AS (SELECT entity AS source, category, term_value FROM ann WHERE entity < (SELECT h FROM half)), gold AS (SELECT entity AS target, category, term_value FROM ann WHERE entity >= (SELECT h FROM half))"""

PRED_A = "pa AS (SELECT target, source, 'A_direct_ortholog' AS method, category AS annotation_category, term_value, 'high' AS transfer_confidence FROM prs JOIN src USING (source))"
ARCH = """ar AS (SELECT source, target, count(*) FILTER (WHERE s = 3) AS shared, round(count(*) FILTER (WHERE s = 3) / count(*), 4) AS j FROM (
  SELECT source, target, term_value, sum(s) AS s FROM (SELECT source, target, term_value, 1 AS s FROM prs JOIN src USING (source) WHERE category = 'domain_type'
    UNION ALL SELECT source, target, term_value, 2 FROM prs JOIN gold USING (target) WHERE category = 'domain_type') GROUP BY ALL) GROUP BY ALL)"""
PRED_B = ARCH + """,
pb AS (SELECT target, source, 'B_domain_architecture' AS method, category AS annotation_category, term_value, CASE WHEN category = 'domain_type' THEN 'high' ELSE 'medium' END AS transfer_confidence,
  shared AS shared_domain_count, j AS architecture_jaccard, 'FULL' AS architecture_mode, round(j * CASE WHEN category = 'domain_type' THEN 1.0 ELSE 0.7 END, 4) AS architecture_score
  FROM prs JOIN ar USING (source, target) JOIN src USING (source) WHERE category = 'domain_type' OR shared > 0)"""
PRED_C = """mem AS (SELECT c_custkey AS accession, CASE WHEN c_custkey < h THEN 'human' ELSE 'mouse' END AS species, c_nationkey * 100 + (c_custkey % 40) AS cluster FROM customer, half),
fst AS (SELECT cluster, min(accession) AS source FROM mem WHERE species = 'human' GROUP BY cluster),
pc AS (SELECT accession AS target, fst.source, 'C_nearest_sequence' AS method, category AS annotation_category, term_value, 'sequence_based' AS transfer_confidence FROM mem JOIN fst USING (cluster) JOIN src ON src.source = fst.source WHERE species = 'mouse')"""


def predictions_b(spark, sf):
    source, gold = sides(spark, sf)
    left = source.filter("annotation_category = 'domain_type'").select("source", F.concat(F.lit("PFAM:"), "term_value").alias("domain"))
    right = gold.filter("category = 'domain_type'").select("target", F.col("term_value").alias("domain"))
    return tr.transfer_architecture(pairs(spark, sf), source, left, right)


def members(spark, sf):
    half = table(spark, sf, "customer").agg((F.count(F.lit(1)) / 2).cast("int").alias("h")).scalar()
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("accession"), F.when(F.col("c_custkey") < half, "human").otherwise("mouse").alias("species"),
        (F.col("c_nationkey") * 100 + F.col("c_custkey") % 40).alias("cluster"), F.col("c_custkey").alias("position"),
    )


def all_predictions(spark, sf):
    source, _ = sides(spark, sf)
    a = tr.transfer_direct(pairs(spark, sf), source)
    c = tr.transfer_cluster(members(spark, sf), source)
    return union_all([a, predictions_b(spark, sf).select(*a.columns), c]).withColumnRenamed("annotation_category", "category")


ALL = f"""{ANN}, {PRED_A}, {PRED_B}, {PRED_C},
pred AS (SELECT target, source, method, annotation_category AS category, term_value, transfer_confidence FROM pa UNION ALL SELECT target, source, method, annotation_category, term_value, transfer_confidence FROM pb UNION ALL SELECT target, source, method, annotation_category, term_value, transfer_confidence FROM pc)"""


@query("j14_transfer_direct", f"WITH {ANN}, {PRED_A} SELECT * FROM pa")
def transfer_direct(spark, sf):
    return tr.transfer_direct(pairs(spark, sf), sides(spark, sf)[0])


@query("j15_transfer_architecture", f"WITH {ANN}, {PRED_B} SELECT * FROM pb")
def transfer_architecture(spark, sf):
    return predictions_b(spark, sf)


@query("j16_transfer_cluster", f"WITH {ANN}, {PRED_C} SELECT * FROM pc")
def transfer_cluster(spark, sf):
    return tr.transfer_cluster(members(spark, sf), sides(spark, sf)[0])


@query("a32_prediction_stats", f"WITH {ALL} SELECT method, count(*) FILTER (WHERE category = 'domain_type') AS domain_type, count(*) FILTER (WHERE category = 'function') AS function, count(*) FILTER (WHERE category = 'topology') AS topology FROM pred GROUP BY method")
def prediction_stats(spark, sf):
    return tr.prediction_stats(all_predictions(spark, sf).withColumnRenamed("category", "annotation_category"), CATEGORIES)


@query("a32_architecture_stats", f"""WITH {ANN}, {PRED_B} SELECT architecture_mode, count(*) AS n, round(avg(architecture_jaccard), 3) AS mean_jaccard, round(median(architecture_jaccard), 3) AS median_jaccard,
  round(min(architecture_jaccard), 3) AS min_jaccard, round(max(architecture_jaccard), 3) AS max_jaccard FROM pb GROUP BY 1""")
def architecture_stats(spark, sf):
    return tr.architecture_stats(predictions_b(spark, sf))


@query("j17_match_sets", f"""WITH {ANN}, p AS (SELECT DISTINCT target, category, term_value FROM prs JOIN src USING (source))
SELECT coalesce(g.target, p.target) AS target, coalesce(g.category, p.category) AS category, coalesce(g.term_value, p.term_value) AS term_value,
  CASE WHEN g.target IS NOT NULL AND p.target IS NOT NULL THEN 'TP' WHEN g.target IS NOT NULL THEN 'FN' ELSE 'FP' END AS status
FROM gold g FULL JOIN p ON g.target = p.target AND g.category = p.category AND g.term_value = p.term_value""")
def match_sets(spark, sf):
    source, gold = sides(spark, sf)
    pred = tr.transfer_direct(pairs(spark, sf), source).withColumnRenamed("annotation_category", "category")
    return tr.match_sets(gold, pred, ["target", "category", "term_value"])


def relation_sets(spark, sf, status: str):
    """(relation, type, value) distinct tokens of several columns for one line status."""
    from annospan.functions.cells import extract_ids, norm_value, relation_alias

    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).filter(F.col("l_linestatus") == status)
    cell = F.concat_ws(";", F.concat(F.lit("DOT:0000"), text(F.col("l_suppkey") % 10), F.lit(" x")), F.concat(F.lit("DOT:0001"), text(F.col("l_partkey") % 7)))
    rows = F.array(
        F.struct(F.lit("hasFunctionTag").alias("r"), F.array(F.concat(F.lit("DOF:1 "), "l_returnflag")).alias("v")),
        F.struct(F.lit("bindingTarget").alias("r"), extract_ids(cell, r"DOT:\d+").alias("v")),
    )
    return joined.select("p_brand", F.explode(rows).alias("x")).select(
        relation_alias("x.r").alias("relation"), F.col("p_brand").alias("type"), F.explode("x.v").alias("v")
    ).select("relation", "type", norm_value("v").alias("value")).distinct()


RELATIONS = """rel AS (SELECT l_linestatus AS st, 'function_tag' AS relation, p_brand AS type, l_returnflag AS value FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_linestatus, 'binding_target', p_brand, unnest(['DOT:0000' || (l_suppkey % 10), 'DOT:0001' || (l_partkey % 7)]) FROM lineitem JOIN part ON l_partkey = p_partkey),
gs AS (SELECT DISTINCT relation, type, value FROM rel WHERE st = 'F'), ps AS (SELECT DISTINCT relation, type, value FROM rel WHERE st = 'O')"""


@query("j18_derive_gold", f"WITH {RELATIONS} SELECT * FROM gs")
def derive_gold(spark, sf):
    return relation_sets(spark, sf, "F")


@query("j19_derive_predictions", f"WITH {RELATIONS} SELECT * FROM ps")
def derive_predictions(spark, sf):
    return relation_sets(spark, sf, "O")


@query("m20_benchmark_prf", f"""WITH {RELATIONS},
m AS (SELECT coalesce(g.relation, p.relation) AS relation, g.value IS NOT NULL AS g, p.value IS NOT NULL AS p FROM gs g FULL JOIN ps p ON g.relation = p.relation AND g.type = p.type AND g.value = p.value),
c AS (SELECT relation, count(*) FILTER (WHERE g AND p) AS n_tp, count(*) FILTER (WHERE p) AS n_pred, count(*) FILTER (WHERE g) AS n_gold FROM m GROUP BY 1)
SELECT *, round(n_tp / n_pred, 4) AS precision, round(n_tp / n_gold, 4) AS recall, round(2 * (n_tp / n_pred) * (n_tp / n_gold) / (n_tp / n_pred + n_tp / n_gold), 4) AS f1, round(n_tp / (n_pred + n_gold - n_tp), 4) AS jaccard FROM c""")
def benchmark_prf(spark, sf):
    return tr.prf(relation_sets(spark, sf, "F"), relation_sets(spark, sf, "O"), ["relation"], ["type", "value"])


def prf_sql(empty: str = "1.0") -> str:
    none = "n_pred = 0 AND n_gold = 0"
    p, r = "(CASE WHEN n_pred > 0 THEN n_tp / n_pred ELSE 0.0 END)", "(CASE WHEN n_gold > 0 THEN n_tp / n_gold ELSE 0.0 END)"
    return f"""CASE WHEN {none} THEN {empty} ELSE round({p}, 4) END AS precision, CASE WHEN {none} THEN {empty} ELSE round({r}, 4) END AS recall,
  CASE WHEN {none} THEN {empty} WHEN n_tp > 0 THEN round(2 * {p} * {r} / ({p} + {r}), 4) ELSE 0.0 END AS f1, CASE WHEN {none} THEN {empty} ELSE round(n_tp / (n_pred + n_gold - n_tp), 4) END AS jaccard"""


EVAL = f"""{ALL},
grid AS (SELECT target, category, method FROM (SELECT DISTINCT target FROM gold) CROSS JOIN (VALUES ('domain_type'), ('function'), ('topology')) c(category) CROSS JOIN (VALUES ('A_direct_ortholog'), ('B_domain_architecture'), ('C_nearest_sequence')) m(method)),
dp AS (SELECT DISTINCT method, target, category, term_value FROM pred),
hit AS (SELECT method, target, category, count(*) AS n_pred, count(g.term_value) AS n_tp FROM dp LEFT JOIN gold g USING (target, category, term_value) GROUP BY 1, 2, 3),
ng AS (SELECT target, category, count(*) AS n_gold FROM gold GROUP BY 1, 2),
cell AS (SELECT method, target, category, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_tp, 0) AS n_tp FROM grid LEFT JOIN ng USING (target, category) LEFT JOIN hit USING (method, target, category)),
per AS (SELECT *, {prf_sql()} FROM cell)"""
METHODS = ["A_direct_ortholog", "B_domain_architecture", "C_nearest_sequence"]


def per_protein(spark, sf):
    return tr.evaluate(sides(spark, sf)[1], all_predictions(spark, sf), METHODS, CATEGORIES)


@query("m21_evaluate", f"WITH {EVAL} SELECT * FROM per")
def evaluate(spark, sf):
    return per_protein(spark, sf)


@query("m21_evaluation_summary", f"WITH {EVAL} SELECT method, category, {MEANS}, count(*) AS n_targets FROM per GROUP BY 1, 2")
def evaluation_summary(spark, sf):
    return tr.evaluation_summary(per_protein(spark, sf))


@query("m22_bootstrap_ci", f"""WITH v AS (SELECT c_mktsegment AS seg, c_custkey AS id, c_acctbal AS x FROM customer),
r AS (SELECT seg, x, row_number() OVER (PARTITION BY seg ORDER BY md5(CAST(id AS VARCHAR)), id) AS k, count(*) OVER (PARTITION BY seg) AS n FROM v),
d AS (SELECT a.seg, iteration, CAST(('0x' || substr(md5('{SEED}|' || a.seg || '|' || iteration || '|' || a.k), 1, 13)) AS BIGINT) % a.n + 1 AS k FROM r a CROSS JOIN (SELECT unnest(range(1, 1001)) AS iteration)),
m AS (SELECT seg, iteration, avg(x) AS m FROM d JOIN r USING (seg, k) GROUP BY 1, 2)
SELECT seg, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS ci_lower, round(quantile_cont(m, 0.975), 4) AS ci_upper FROM m GROUP BY seg""")
def bootstrap_ci(spark, sf):
    v = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    return tr.bootstrap_ci(v, "x", ["seg"], "id", n=1000)


@query("m23_random_control", f"""WITH {ANN},
s AS (SELECT source, row_number() OVER (ORDER BY md5(CAST(source AS VARCHAR)) || source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM src)),
d AS (SELECT target, category, iteration, CAST(('0x' || substr(md5('{SEED}|' || target || '|' || category || '|' || iteration), 1, 13)) AS BIGINT) % (SELECT max(n) FROM s) + 1 AS k
  FROM (SELECT DISTINCT target FROM gold) CROSS JOIN (VALUES ('domain_type'), ('function'), ('topology')) c(category) CROSS JOIN (SELECT unnest(range(1, 101)) AS iteration)),
x AS (SELECT target, category, iteration, source FROM d JOIN s USING (k)),
ng AS (SELECT target, category, count(*) AS n_gold FROM gold GROUP BY 1, 2), np AS (SELECT source, category, count(*) AS n_pred FROM src GROUP BY 1, 2),
t AS (SELECT target, category, source, count(*) AS n_tp FROM (SELECT DISTINCT target, category, source FROM x) JOIN src USING (source, category) JOIN gold USING (target, category, term_value) GROUP BY 1, 2, 3),
f AS (SELECT target, category, coalesce(n_gold, 0) AS g, coalesce(n_pred, 0) AS p, coalesce(n_tp, 0) AS t FROM x LEFT JOIN ng USING (target, category) LEFT JOIN np USING (source, category) LEFT JOIN t USING (target, category, source)),
j AS (SELECT target, category, CASE WHEN g = 0 AND p = 0 THEN 1.0 ELSE round(t / (g + p - t), 4) END AS j FROM f)
SELECT target, category, round(avg(j), 8) AS jaccard, round(stddev_pop(j), 6) AS jaccard_std FROM j GROUP BY 1, 2""")
def random_control(spark, sf):
    source, gold = sides(spark, sf)
    return tr.random_control(gold, source.withColumnRenamed("annotation_category", "category"), CATEGORIES, n=100, digits=(8, 6))


@query("m24_permutation_f1", f"""WITH {ANN}, b AS (SELECT source, target FROM prs),
pm AS (SELECT iteration, source, target FROM
  (SELECT iteration, source, row_number() OVER (PARTITION BY iteration ORDER BY md5('{SEED}|fixed|' || source || '|' || target), source || '|' || target) AS k FROM b CROSS JOIN (SELECT unnest(range(1, 1001)) AS iteration))
  JOIN (SELECT iteration, target, row_number() OVER (PARTITION BY iteration ORDER BY md5('{SEED}|' || iteration || '|' || source || '|' || target), source || '|' || target) AS k FROM b CROSS JOIN (SELECT unnest(range(1, 1001)) AS iteration)) USING (iteration, k)),
al AS (SELECT iteration, source, target FROM pm UNION ALL SELECT 0, source, target FROM b),
pr AS (SELECT DISTINCT iteration, target, category, term_value FROM al JOIN src USING (source)),
hit AS (SELECT iteration, target, category, count(*) AS n_pred, count(g.term_value) AS n_tp FROM pr LEFT JOIN gold g USING (target, category, term_value) GROUP BY 1, 2, 3),
ng AS (SELECT target, category, count(*) AS n_gold FROM gold GROUP BY 1, 2),
grid AS (SELECT iteration, target, category FROM (SELECT DISTINCT iteration FROM al) CROSS JOIN (SELECT DISTINCT target FROM gold) CROSS JOIN (VALUES ('domain_type'), ('function'), ('topology')) c(category)),
cell AS (SELECT iteration, category, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_tp, 0) AS n_tp FROM grid LEFT JOIN ng USING (target, category) LEFT JOIN hit USING (iteration, target, category)),
sc AS (SELECT iteration, category, {prf_sql()} FROM cell), mf AS (SELECT iteration, category, sum(round(f1 * 10000)::BIGINT)::BIGINT AS s, count(*) AS t FROM sc GROUP BY 1, 2),
o AS (SELECT category, s AS observed FROM mf WHERE iteration = 0)
SELECT category, floor((2 * any_value(observed) + any_value(t)) / (2 * any_value(t))) / 10000 AS observed_f1, floor((2 * sum(s) + any_value(t) * count(*)) / (2 * any_value(t) * count(*))) / 10000 AS null_mean,
  round(stddev_pop(s) / any_value(t) / 10000, 4) AS null_std, round(count(*) FILTER (WHERE s >= observed) / count(*), 4) AS p_value FROM mf JOIN o USING (category) WHERE iteration > 0 GROUP BY category""")
def permutation_f1(spark, sf):
    source, gold = sides(spark, sf)
    return tr.permutation_f1(pairs(spark, sf), source.withColumnRenamed("annotation_category", "category"), gold, CATEGORIES)


@query("m25_difficulty_strata", f"""WITH {EVAL}, d AS (SELECT target, CASE WHEN source % 101 / 100.0 >= 0.999 THEN 'easy' WHEN source % 101 / 100.0 >= 0.7 THEN 'medium' ELSE 'hard' END AS difficulty FROM prs)
SELECT method, difficulty, category, {MEANS}, count(*) AS n_targets FROM per JOIN (SELECT DISTINCT * FROM d) USING (target) GROUP BY 1, 2, 3""")
def difficulty(spark, sf):
    from annospan.functions.tiers import difficulty_tier

    tiers = pairs(spark, sf).select("target", difficulty_tier(F.col("source") % 101 / 100).alias("difficulty"))
    return tr.evaluate_by(per_protein(spark, sf), tiers, "difficulty")


@query("m26_calibration", f"""WITH {ALL} SELECT method, transfer_confidence, count(*) AS n_preds, count(g.term_value) AS n_tp, round(count(g.term_value) / count(*), 4) AS precision FROM pred LEFT JOIN gold g USING (target, category, term_value) GROUP BY 1, 2""")
def calibration(spark, sf):
    return tr.calibration(all_predictions(spark, sf), sides(spark, sf)[1])


SPLIT = f"""sp AS (SELECT *, CASE WHEN n >= 2 AND k <= greatest(round_even(n * 0.2, 0), 1) THEN 'test' ELSE 'calibration' END AS split FROM (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('{SEED}|' || o_orderkey) || o_orderkey) AS k FROM orders))"""


def split(spark, sf):
    return tr.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", F.col("o_orderkey"))


@query("m27_stratified_split", f"WITH {SPLIT} SELECT o_orderkey, o_orderpriority, split FROM sp")
def stratified_split(spark, sf):
    return split(spark, sf)


@query("a33_split_summary", f"WITH {SPLIT} SELECT o_orderpriority, split, count(*) AS n_pairs FROM sp GROUP BY 1, 2")
def split_summary(spark, sf):
    return tr.split_summary(split(spark, sf), "o_orderpriority")


@query("m28_blind_guard", f"""WITH {ANN} SELECT 'held_out_pair' AS kind, source || '|' || target AS value FROM prs WHERE c_nationkey = 3 UNION ALL SELECT 'target_category', 'function'""")
def blind_guard(spark, sf):
    from annospan.operators.reshape import STRUCTURAL_CATEGORIES

    _, gold = sides(spark, sf)
    all_pairs = pairs(spark, sf)
    return tr.blind_violations(all_pairs, all_pairs.filter("c_nationkey = 3"), gold.withColumnRenamed("category", "annotation_category"), STRUCTURAL_CATEGORIES)


@query("w12_ortholog_type", """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'many2one' WHEN count(*) OVER (PARTITION BY b) > 1 THEN 'one2many' ELSE 'one2one' END AS ortholog_type
FROM (SELECT *, o_orderkey // 3 AS b FROM orders)""")
def ortholog_type(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.floor(F.col("o_orderkey") / 3).alias("b"))
    return tr.ortholog_type(orders, "b", "o_custkey").drop("b")


@query("j13_candidate_pairs")
def candidate_pairs(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    left = customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("length")).select(
        F.concat_ws("-", "c_mktsegment", text("c_nationkey")).alias("accession"), F.concat("c_mktsegment", text("c_nationkey")).alias("gene"),
        F.col("c_mktsegment").alias("grp"), "length", text("c_nationkey").alias("cluster"),
    )
    right = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("length")).select(
        F.concat_ws("-", "o_orderpriority", "c_mktsegment", text("c_nationkey")).alias("accession"), F.concat(F.split("o_orderpriority", "-")[1], text("c_nationkey")).alias("gene"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("c_mktsegment")).otherwise("other").alias("grp"), "length", text("c_nationkey").alias("cluster"),
    )
    return tr.score_pairs(left, right)


@query("j13_symbol_tiers", """
WITH l AS (SELECT c_mktsegment || '-' || c_nationkey AS acc, repeat(chr(65 + c_nationkey), 3) || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE CAST(length(c_mktsegment) AS VARCHAR) END AS gene, c_mktsegment AS grp, count(*) AS len, c_nationkey AS cl FROM customer GROUP BY ALL),
r AS (SELECT CAST(s_suppkey AS VARCHAR) AS acc, repeat(chr(65 + s_nationkey), 3) AS gene, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'other' END AS grp, s_suppkey % 90 + 1 AS len, s_suppkey % 25 AS cl FROM supplier),
p AS (SELECT l.acc AS a_accession, r.acc AS b_accession, CASE WHEN l.gene = r.gene THEN 1.0 WHEN l.gene[1] = r.gene[1] THEN 0.9 ELSE 0.0 END AS sim, l.cl = r.cl AS same_cluster, l.grp = r.grp AS same_group, least(l.len, r.len) / greatest(l.len, r.len) AS ratio FROM l, r)
SELECT a_accession, b_accession, sim AS gene_similarity, same_cluster, same_group, round(same_cluster::INT * 3.0 + sim * 2.5 + same_group::INT + ratio * 0.5, 6) AS candidate_score
FROM p WHERE same_cluster::INT * 3.0 + sim * 2.5 + same_group::INT + ratio * 0.5 >= 1.0 AND (same_cluster OR same_group OR sim > 0)""")
def symbol_tiers(spark, sf):
    letters = lambda c: F.repeat(F.char(F.lit(65) + F.col(c)), 3)
    left = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("length")).select(
        F.concat_ws("-", "c_mktsegment", text("c_nationkey")).alias("accession"),
        F.concat(letters("c_nationkey"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(text(F.length("c_mktsegment")))).alias("gene"),
        F.col("c_mktsegment").alias("grp"), "length", text("c_nationkey").alias("cluster"),
    )
    key = F.col("s_suppkey")
    right = table(spark, sf, "supplier").select(
        text(key).alias("accession"), letters("s_nationkey").alias("gene"), F.when(key % 3 == 0, "BUILDING").otherwise("other").alias("grp"),
        (key % 90 + 1).alias("length"), text(key % 25).alias("cluster"),
    )
    out = tr.score_pairs(left, right).withColumn("candidate_score", F.round("candidate_score", 6))
    return out.select("a_accession", "b_accession", "gene_similarity", "same_cluster", "same_group", "candidate_score")


@query("j20_assign_group", """SELECT c_custkey, coalesce(CASE WHEN c_nationkey < 5 THEN c_mktsegment END, CASE WHEN c_name LIKE '%7%' THEN 'seven' WHEN c_name LIKE '%3%' OR c_name LIKE '%5%' THEN 'odd' ELSE 'other' END) AS grp FROM customer""")
def assign_group(spark, sf):
    from annospan.operators.similarity import assign_group as assign

    customer = table(spark, sf, "customer")
    labels = customer.filter("c_nationkey < 5").select("c_name", F.col("c_mktsegment").alias("grp"))
    return assign(customer.select("c_custkey", "c_name"), "c_name", labels, "grp", {"seven": ["7"], "odd": ["3", "5"]}).drop("c_name")
