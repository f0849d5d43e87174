"""Two tables side by side: returned lines and accepted lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.functions.cells import split_cell
from annospan.operators import compare as cp
from annospan.operators.common import union_all
from annospan.plans.base import OCC, occurrences, query, table, text



def halves(spark, sf):
    """Occurrences of returned and of kept lines: two annotated tables with shared vocabulary."""
    occ = occurrences(spark, sf).withColumns({
        "tags": F.concat_ws(";", F.split("pname", " ")[0], F.concat(F.lit("S"), text(F.col("supp") % 40)), F.when(F.col("flag") == "R", F.concat(F.lit("r"), text(F.col("part") % 13)))),
        "owner": F.col("part") % 500,
    })
    return occ.filter("flag = 'R'"), occ.filter("flag <> 'R'")


HALVES = f"""{OCC},
t AS (SELECT * REPLACE (CASE WHEN flag = 'R' THEN 'R' ELSE 'A' END AS flag), part % 500 AS owner, concat_ws(';', split_part(pname, ' ', 1), 'S' || (supp % 40), CASE WHEN flag = 'R' THEN 'r' || (part % 13) END) AS tags FROM occ),
long AS (SELECT flag, owner, 'type' AS category, acc AS token FROM t UNION ALL
  SELECT flag, owner, 'tags', unnest(string_split(tags, ';')) FROM t),
tok AS (SELECT category, token, CAST(sum((flag = 'R')::INT) AS BIGINT) AS n_a, CAST(sum((flag = 'A')::INT) AS BIGINT) AS n_b FROM long GROUP BY 1, 2)"""



def columns():
    return {"type": F.array("acc"), "tags": split_cell("tags")}


@query("u01_category_overlap", f"""WITH {HALVES},
k AS (SELECT *, CASE WHEN n_a > 0 AND n_b > 0 THEN 'shared' WHEN n_a > 0 THEN 'only_a' ELSE 'only_b' END AS kind FROM tok),
s AS (SELECT category, CAST(sum((kind = 'shared')::INT) AS BIGINT) AS shared, CAST(sum((kind = 'only_a')::INT) AS BIGINT) AS only_a, CAST(sum((kind = 'only_b')::INT) AS BIGINT) AS only_b FROM k GROUP BY 1),
l AS (SELECT category, kind, string_agg(token, ';' ORDER BY token) AS items FROM (SELECT *, row_number() OVER (PARTITION BY category, kind ORDER BY token) AS rn FROM k) WHERE rn <= 10 GROUP BY 1, 2)
SELECT s.category, shared + only_a AS size_a, shared + only_b AS size_b, shared, only_a, only_b, round(shared / (shared + only_a + only_b), 4) AS jaccard,
  coalesce(max(items) FILTER (WHERE kind = 'shared'), '') AS shared_items, coalesce(max(items) FILTER (WHERE kind = 'only_a'), '') AS only_a_items, coalesce(max(items) FILTER (WHERE kind = 'only_b'), '') AS only_b_items
FROM s LEFT JOIN l ON l.category = s.category GROUP BY ALL""")
def category_overlap(spark, sf):
    a, b = halves(spark, sf)
    return cp.overlap_metrics(a, b, columns())


@query("u01_overlap_items", f"WITH {HALVES} SELECT category, token, CASE WHEN n_a > 0 AND n_b > 0 THEN 'shared' WHEN n_a > 0 THEN 'only_a' ELSE 'only_b' END AS kind FROM tok")
def overlap_items(spark, sf):
    return cp.overlap_items(*halves(spark, sf), columns())


@query("u02_schema_overlap", """
WITH u AS (UNPIVOT (SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority FROM orders) ON COLUMNS(*) INTO NAME column_name VALUE v)
SELECT column_name, column_name IN ('o_orderkey', 'o_custkey') AS in_a, TRUE AS in_b, count(v) AS n_filled, count(DISTINCT v) AS n_distinct FROM u GROUP BY 1""")
def schema_overlap(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    shared = cp.schema_overlap(orders.select("o_orderkey", "o_custkey"), orders)
    return shared.join(cp.profile(orders, orders.columns).select("column_name", "n_filled", "n_distinct"), "column_name")


@query("u03_set_similarity", f"""WITH {OCC}, x AS (SELECT protein, list(DISTINCT acc) FILTER (WHERE flag = 'R') AS a, list(DISTINCT acc) FILTER (WHERE flag <> 'R') AS b FROM occ GROUP BY protein),
y AS (SELECT protein, coalesce(a, []) AS a, coalesce(b, []) AS b FROM x), z AS (SELECT protein, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM y)
SELECT protein, round(i / (na + nb - i), 4) AS jaccard, CASE WHEN least(na, nb) = 0 THEN 1.0 ELSE round(i / least(na, nb), 4) END AS overlap FROM z""")
def set_similarity(spark, sf):
    sets = occurrences(spark, sf).groupBy("protein").agg(
        F.collect_set(F.when(F.col("flag") == "R", F.col("acc"))).alias("a"), F.collect_set(F.when(F.col("flag") != "R", F.col("acc"))).alias("b")
    )
    return sets.select("protein", F.round(cp.jaccard(F.col("a"), F.col("b")), 4).alias("jaccard"), F.round(cp.overlap_coeff(F.col("a"), F.col("b"), 1.0), 4).alias("overlap"))


@query("u04_token_set", f"WITH {HALVES} SELECT DISTINCT lower(token) AS token FROM long WHERE flag = 'R' AND category = 'tags'")
def token_set(spark, sf):
    return cp.token_set(halves(spark, sf)[0], split_cell("tags"))


@query("a26_table_profile", """
WITH v AS (SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS st, o_orderpriority AS pr FROM orders),
u AS (SELECT 'key' AS column_name, k AS v FROM v UNION ALL SELECT 'status', nullif(trim(st), '') FROM v UNION ALL SELECT 'priority', pr FROM v)
SELECT column_name, count(*) AS n_rows, count(v) AS n_filled, count(DISTINCT v) AS n_distinct, round(count(v) * 100.0 / count(*), 2) AS pct_filled FROM u GROUP BY 1""")
def table_profile(spark, sf):
    orders = table(spark, sf, "orders").select(
        text("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority")
    )
    return cp.profile(orders, ["key", "status", "priority"])


@query("a26_vocabulary_rate", f"""WITH {HALVES}
SELECT category, count(*) AS n_tokens, count(*) FILTER (WHERE token LIKE 'S%' OR category = 'type') AS n_backed, round(count(*) FILTER (WHERE token LIKE 'S%' OR category = 'type') / count(*), 4) AS backed_rate
FROM (SELECT DISTINCT category, token FROM long WHERE flag = 'A') GROUP BY 1""")
def vocabulary_rate(spark, sf):
    a, b = halves(spark, sf)
    tokens = cp.long_tokens(b, columns())
    vocabulary = cp.long_tokens(union_all([a, b]), columns()).filter("token like 'S%' or category = 'type'")
    return cp.vocabulary_rate(tokens, vocabulary)


@query("a27_transfer_metrics", f"""WITH {HALVES}, vocab AS (SELECT DISTINCT category, token FROM tok WHERE token < 'g' OR category = 'type' UNION SELECT 'tags', 'unused'),
j AS (SELECT coalesce(n_a > 0, FALSE) AS a, coalesce(n_b > 0, FALSE) AS b, v.token IS NOT NULL AS v FROM tok FULL JOIN vocab v USING (category, token)),
s AS (SELECT count(*) FILTER (WHERE a AND b) AS cons, count(*) FILTER (WHERE b AND NOT a) AS new, count(*) FILTER (WHERE a AND NOT b) AS unused,
  count(*) FILTER (WHERE a AND v) AS ra, count(*) FILTER (WHERE a AND b AND v) AS rb, count(*) FILTER (WHERE b) AS tb, count(*) FILTER (WHERE b AND v) AS tv FROM j)
SELECT 'conserved_terms' AS metric, cons::DOUBLE AS value FROM s UNION ALL SELECT 'new_terms', new FROM s UNION ALL SELECT 'unused_terms', unused FROM s
UNION ALL SELECT 'vocabulary_reuse', round(rb / ra, 4) FROM s UNION ALL SELECT 'mapping_completeness', round(tv / tb, 4) FROM s UNION ALL SELECT 'species_specific_rate', round(new / tb, 4) FROM s
UNION ALL SELECT * FROM (VALUES ('schema_reuse_rate', 0.75), ('n_shared_columns', 3), ('n_first_only_columns', 1), ('n_second_only_columns', 1), ('rule_portability_rate', round(2 / 3, 4)), ('n_testable_rules', 2), ('n_total_rules', 3))""")
def transfer_metrics(spark, sf):
    a, b = halves(spark, sf)
    both = cp.long_tokens(union_all([a, b]), columns()).filter("token < 'g' or category = 'type'")
    extra = both.select(F.lit("tags").alias("category"), F.lit("unused").alias("token")).distinct()
    schema = cp.schema_metrics(a.select("acc", "tags", "owner", "line"), b.select("acc", "tags", "owner", "status"), ["acc", "tags", "line"])
    return cp.transfer_metrics(a, b, columns(), both.unionByName(extra)).unionByName(schema)


@query("a28_token_report", f"""WITH {HALVES}, c AS (SELECT flag, category, token, count(*) AS n FROM long GROUP BY ALL),
s AS (SELECT flag, category, count(*)::DOUBLE AS u, round(100 * sum(CASE WHEN token LIKE 'S%' OR category = 'type' THEN n ELSE 0 END) / sum(n), 1) AS r FROM c GROUP BY ALL),
m AS (SELECT flag, 'unique_' || category AS metric, u AS v FROM s UNION ALL SELECT flag, 'backed_rate_' || category, r FROM s)
SELECT a.metric, a.v AS value_a, b.v AS value_b, round(b.v - a.v, 2) AS delta FROM m a JOIN m b USING (metric) WHERE a.flag = 'R' AND b.flag = 'A'""")
def token_report(spark, sf):
    a, b = halves(spark, sf)
    vocabulary = cp.long_tokens(union_all([a, b]), columns()).filter("token like 'S%' or category = 'type'")
    return cp.token_report(a, b, columns(), vocabulary)


@query("a28_comparison_report", f"""WITH {OCC}, s AS (SELECT CASE WHEN flag = 'R' THEN 'R' ELSE 'A' END AS flag, count(*)::DOUBLE AS rows, count(DISTINCT protein)::DOUBLE AS proteins, count(DISTINCT acc)::DOUBLE AS types, round(avg("end" - start + 1), 6) AS mean_length FROM occ GROUP BY 1),
u AS (UNPIVOT s ON rows, proteins, types, mean_length INTO NAME metric VALUE v)
SELECT a.metric, a.v AS value_a, b.v AS value_b, round(b.v - a.v, 4) AS delta FROM u a JOIN u b USING (metric) WHERE a.flag = 'R' AND b.flag = 'A'""")
def comparison_report(spark, sf):
    a, b = halves(spark, sf)
    return cp.comparison_report(a, b, {
        "rows": F.count(F.lit(1)), "proteins": F.countDistinct("protein"), "types": F.countDistinct("acc"),
        "mean_length": F.round(F.avg(F.col("end") - F.col("start") + 1), 6),
    })


@query("a29_domain_conservation", """
WITH x AS (SELECT p_name || ' ' || p_brand AS d, CAST(sum((c_nationkey < 12)::INT) AS BIGINT) AS n_a, CAST(sum((c_nationkey >= 12)::INT) AS BIGINT) AS n_b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
k AS (SELECT *, CASE WHEN n_a > 0 AND n_b > 0 THEN 'shared' WHEN n_a > 0 THEN 'only_a' ELSE 'only_b' END AS kind FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_a + n_b DESC, d) AS rn FROM k)
SELECT kind, d AS domain_type, n_a, n_b FROM r WHERE rn <= CASE WHEN kind = 'shared' THEN 8 ELSE 6 END""")
def domain_conservation(spark, sf):
    line, orders, customer, part = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "part"))
    all_lines = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey")).select("c_nationkey", F.concat_ws(" ", "p_name", "p_brand").alias("d"))
    )
    return cp.domain_conservation(all_lines.filter("c_nationkey < 12"), all_lines.filter("c_nationkey >= 12"), "d")


@query("a30_tag_profile", f"""WITH {HALVES}, s AS (SELECT sum(n_a) AS sa, sum(n_b) AS sb FROM tok WHERE category = 'tags')
SELECT token, n_a, n_b, round(n_a / greatest(sa, 1), 4) AS frac_a, round(n_b / greatest(sb, 1), 4) AS frac_b FROM tok, s WHERE category = 'tags' ORDER BY n_a + n_b DESC, token LIMIT 15""")
def tag_profile(spark, sf):
    a, b = halves(spark, sf)
    return cp.tag_profile(a, b, split_cell("tags"))


AGREE = f"""{HALVES},
et AS (SELECT owner, category, token, bool_or(flag = 'R') AS a, bool_or(flag = 'A') AS b FROM long GROUP BY 1, 2, 3),
ag AS (SELECT owner, category AS source, CAST(sum(a::INT) AS BIGINT) AS n_own, CAST(sum(b::INT) AS BIGINT) AS n_external, CAST(sum((a AND b)::INT) AS BIGINT) AS n_shared FROM et GROUP BY 1, 2),
agr AS (SELECT *, round(n_shared / (n_own + n_external - n_shared), 4) AS jaccard, CASE WHEN least(n_own, n_external) = 0 THEN 0.0 ELSE round(n_shared / least(n_own, n_external), 4) END AS overlap_coefficient FROM ag)"""


@query("a31_external_agreement", f"WITH {AGREE} SELECT * FROM agr")
def external_agreement(spark, sf):
    a, b = halves(spark, sf)
    return cp.external_agreement(a, b, "owner", columns())


@query("a31_agreement_summary", f"""WITH {AGREE} SELECT source, count(*) AS n_proteins, round(avg(jaccard), 4) AS mean_jaccard, round(avg(overlap_coefficient), 4) AS mean_overlap,
  CAST(sum(n_own) AS BIGINT) AS sum_own, CAST(sum(n_external) AS BIGINT) AS sum_external, CAST(sum(n_shared) AS BIGINT) AS sum_shared FROM agr GROUP BY source""")
def agreement_summary(spark, sf):
    return cp.agreement_summary(external_agreement(spark, sf))


@query("j22_external_mapping", f"""WITH {HALVES}, d AS (SELECT DISTINCT owner, category, token FROM long WHERE flag = 'R')
SELECT owner, coalesce(string_agg(token, ';' ORDER BY token) FILTER (WHERE category = 'type'), '') AS type, coalesce(string_agg(token, ';' ORDER BY token) FILTER (WHERE category = 'tags'), '') AS tags FROM d GROUP BY owner""")
def external_mapping(spark, sf):
    return cp.external_mapping(halves(spark, sf)[0], "owner", columns())


@query("j23_unpaired", """
WITH p AS (SELECT o_custkey AS s, o_orderkey % 300 AS t FROM orders WHERE o_orderstatus = 'F')
SELECT 'left' AS side, CAST(c_custkey AS VARCHAR) AS accession FROM customer WHERE c_custkey NOT IN (SELECT s FROM p)
UNION ALL SELECT 'right', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey NOT IN (SELECT t FROM p)""")
def unpaired(spark, sf):
    pairs = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("s"), (F.col("o_orderkey") % 300).alias("t"))
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return cp.unpaired(left, right, pairs, "id", "s", "t")


CONSERVED = f"""{HALVES}, p AS (SELECT owner AS left_id, (owner * 7 + 3) % 500 AS right_id FROM (SELECT DISTINCT owner FROM t)),
ta AS (SELECT DISTINCT owner, category, token FROM long WHERE flag = 'R'), tb AS (SELECT DISTINCT owner, category, token FROM long WHERE flag = 'A'),
s AS (SELECT left_id, right_id, category, token, 1 AS s FROM p JOIN ta ON owner = left_id UNION ALL SELECT left_id, right_id, category, token, 2 FROM p JOIN tb ON owner = right_id),
m AS (SELECT left_id, right_id, category, token, sum(s) AS s FROM s GROUP BY ALL),
z AS (SELECT left_id, right_id, category, count(*) FILTER (WHERE s <> 2) AS n_a, count(*) FILTER (WHERE s <> 1) AS n_b, count(*) FILTER (WHERE s = 3) AS n_shared,
  coalesce(array_to_string((list(token ORDER BY token) FILTER (WHERE s = 3))[1:8], ';'), '') AS shared_tokens FROM m GROUP BY ALL),
g AS (SELECT left_id, right_id, category FROM p CROSS JOIN (VALUES ('type'), ('tags')) c(category)),
con AS (SELECT left_id, right_id, category, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_shared, 0) AS n_shared, coalesce(shared_tokens, '') AS shared_tokens,
  CASE WHEN coalesce(n_a + n_b - n_shared, 0) = 0 THEN 0.0 ELSE round(n_shared / (n_a + n_b - n_shared), 4) END AS jaccard FROM g LEFT JOIN z USING (left_id, right_id, category))"""


@query("j24_pair_conservation", f"WITH {CONSERVED} SELECT * FROM con")
def pair_conservation(spark, sf):
    a, b = halves(spark, sf)
    pairs = occurrences(spark, sf).select((F.col("part") % 500).alias("left_id")).distinct().withColumn("right_id", (F.col("left_id") * 7 + 3) % 500)
    return cp.pair_conservation(a, b, pairs, "owner", "left_id", "right_id", columns())


@query("j24_conservation_score", f"""WITH {CONSERVED} SELECT left_id, right_id, round(avg(jaccard), 6) AS conservation_score, bool_and(n_a > 0 AND n_b > 0) AS complete, count(*) FILTER (WHERE n_a > 0 AND n_b > 0) AS n_comparable FROM con GROUP BY 1, 2""")
def conservation_score(spark, sf):
    return cp.conservation_score(pair_conservation(spark, sf), "left_id", "right_id", digits=6)
