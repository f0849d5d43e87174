"""Vocabulary injection, carry-over, membership and table checks."""

from __future__ import annotations


from pyspark.sql import functions as F

from annospan.functions.cells import split_cell
from annospan.operators import rules as rl
from annospan.operators import vocab as vc
from annospan.operators.common import union_all
from annospan.plans.base import OCC, occurrences, query, spread_table, table, text


def vocabulary(spark, sf):
    """Brands (some left out) and name words as controlled terms."""
    part = table(spark, sf, "part")
    n = F.regexp_extract("p_brand", r"(\d+)", 1)
    brands = part.select("p_brand", n.alias("n")).distinct().filter("n % 4 <> 0").select(
        F.lit("brand").alias("term_type"), F.concat(F.lit("DOF:"), F.lpad("n", 6, "0")).alias("ID"), F.col("p_brand").alias("Name"),
        F.lower("p_brand").alias("canonical_name"), F.concat(F.lit("B"), F.col("n"), F.lit(";brand "), F.col("n")).alias("synonym"),
    )
    types = part.select("p_type").distinct().filter("p_type <> 'PROMO'").select(
        F.lit("type").alias("term_type"), F.concat(F.lit("DOP:"), F.lpad(text(F.length("p_type")), 5, "0"), F.substring("p_type", 1, 1)).alias("ID"),
        F.col("p_type").alias("Name"), F.lit(None).cast("string").alias("canonical_name"), F.lit(None).cast("string").alias("synonym"),
    )
    return brands.unionByName(types)


def cells(spark, sf):
    """Cells of every part: brand spelled in several ways, type, sometimes already an identifier."""
    k, n = F.col("p_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1)
    brand = F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, F.upper("p_brand")).when(k % 4 == 2, F.concat(F.lit("b"), n)).otherwise(F.concat(F.lit("DOF:"), F.lpad(n, 6, "0"), F.lit(" x")))
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(";", brand, F.when(k % 3 == 0, F.lit("odd one"))).alias("brand_cell"), F.when(k % 5 != 0, F.col("p_type")).alias("type_cell")
    )


CELLS = """
num AS (SELECT *, regexp_extract(p_brand, '(\\d+)', 1) AS n FROM part),
tok AS (SELECT p_partkey, 'brand_cell' AS c, 1 AS pos, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'b' || n ELSE 'DOF:' || lpad(n, 6, '0') || ' x' END AS t, n, p_partkey % 4 = 3 AS has FROM num
  UNION ALL SELECT p_partkey, 'brand_cell', 2, 'odd one', '4', FALSE FROM num WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, 'type_cell', 1, p_type, p_type, FALSE FROM num WHERE p_partkey % 5 <> 0),
m AS (SELECT *, CASE WHEN has THEN t WHEN c = 'brand_cell' AND t <> 'odd one' AND CAST(n AS INT) % 4 <> 0 THEN 'DOF:' || lpad(n, 6, '0') || ' Brand#' || n
  WHEN c = 'type_cell' AND t <> 'PROMO' THEN 'DOP:' || lpad(CAST(length(t) AS VARCHAR), 5, '0') || t[1] || ' ' || t END AS mapped FROM tok)"""


@query("j01_inject_ids", f"""WITH {CELLS}
SELECT p_partkey, string_agg(coalesce(mapped, t), ';' ORDER BY pos) FILTER (WHERE c = 'brand_cell') AS brand_cell, string_agg(coalesce(mapped, t), ';' ORDER BY pos) FILTER (WHERE c = 'type_cell') AS type_cell FROM m GROUP BY p_partkey""")
def inject_ids(spark, sf):
    return vc.inject_ids(cells(spark, sf), vocabulary(spark, sf), {"brand_cell": "brand", "type_cell": "type"}, "p_partkey")[0]


@query("j01_unmapped_tokens", f"WITH {CELLS} SELECT DISTINCT c AS column_name, t AS token FROM m WHERE mapped IS NULL")
def unmapped(spark, sf):
    return vc.inject_ids(cells(spark, sf), vocabulary(spark, sf), {"brand_cell": "brand", "type_cell": "type"}, "p_partkey")[1]


CARRY = """src AS (SELECT l_orderkey, l_linenumber, arg_max(l_returnflag, (l_partkey, l_suppkey)) AS note, arg_max(nullif(CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus ELSE '' END, ''), (l_partkey, l_suppkey)) FILTER (WHERE TRUE) AS ref FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1, 2),
tgt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN 'kept' ELSE ' ' END AS note, NULL::VARCHAR AS ref FROM lineitem)"""


def carried(spark, sf):
    line = table(spark, sf, "lineitem")
    source = line.filter("l_partkey % 3 = 0").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("note"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("position")
    )
    target = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_quantity") > 25, "kept").otherwise(" ").alias("note"))
    return vc.carry_over(target, source, ["l_orderkey", "l_linenumber"], ["note"], "position")


@query("j02_carry_over", f"""WITH {CARRY}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN tgt.note = 'kept' THEN 'kept' ELSE src.note END AS note FROM tgt LEFT JOIN src USING (l_orderkey, l_linenumber)""")
def carry_over(spark, sf):
    return carried(spark, sf)[0]


@query("j02_carry_over_counts", f"""WITH {CARRY}
SELECT 'note' AS column_name, count(*) AS n_filled FROM tgt JOIN src USING (l_orderkey, l_linenumber) WHERE tgt.note <> 'kept'""")
def carry_over_counts(spark, sf):
    return carried(spark, sf)[1]


@query("j12_missing_references", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def missing_references(spark, sf):
    dim = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return rl.missing_reference(table(spark, sf, "customer"), dim, "c_custkey", "c_custkey").select(F.col("row_id").alias("c_custkey"))


def brand_tokens(spark, sf):
    return cells(spark, sf).select(text("p_partkey").alias("row_id"), F.lit("brand").alias("term_type"), F.explode(split_cell("brand_cell")).alias("token"))


@query("j26_vocabulary_index", f"""WITH num AS (SELECT DISTINCT p_brand, regexp_extract(p_brand, '(\\d+)', 1) AS n FROM part),
b AS (SELECT p_brand, n, 'DOF:' || lpad(n, 6, '0') AS id, 'DOF:' || lpad(n, 6, '0') || ' ' || p_brand AS id_label FROM num WHERE CAST(n AS INT) % 4 <> 0),
f AS (SELECT id, id_label, unnest([id, p_brand, id_label, lower(p_brand), 'B' || n, 'brand ' || n, lower(id), lower(id_label), 'b' || n]) AS form FROM b)
SELECT DISTINCT 'brand' AS term_type, form, id, id_label FROM f""")
def vocabulary_index(spark, sf):
    return vc.vocab_index(vocabulary(spark, sf).filter("term_type = 'brand'"))


@query("j26_known_tokens", f"WITH {CELLS} SELECT DISTINCT t AS token, mapped IS NOT NULL AND (NOT has OR CAST(n AS INT) % 4 <> 0) AS known FROM m WHERE c = 'brand_cell'")
def known_tokens(spark, sf):
    return vc.known_tokens(brand_tokens(spark, sf), vc.vocab_index(vocabulary(spark, sf))).select("token", "known")


@query("u06_missing_terms")
def missing_terms(spark, sf):
    return vc.missing_terms(brand_tokens(spark, sf), vc.vocab_index(vocabulary(spark, sf)))


@query("u06_unknown_counts", f"""WITH {CELLS} SELECT 'brand' AS term_type, t AS token, count(*) AS n, FALSE AS known_elsewhere FROM m WHERE c = 'brand_cell' AND (mapped IS NULL OR (has AND CAST(n AS INT) % 4 = 0)) GROUP BY t""")
def unknown_counts(spark, sf):
    return missing_terms(spark, sf).select("term_type", "token", "n", "known_elsewhere")


# Checks --------------------------------------------------------------------


def checked(spark, sf):
    """A table with planted faults: blank keys, bad spans, odd identifiers, wrong columns."""
    occ = occurrences(spark, sf, spread_table)
    k = F.col("part") + F.col("supp")
    return occ.select(
        "key", "protein",
        F.when(k % 50 == 0, " ").when(k % 31 == 0, "bad").otherwise(F.concat(F.lit("Q"), F.lpad(text(F.col("part") % 100000), 5, "0"))).alias("protein_accession"),
        F.when(k % 7 == 0, F.concat(F.lit("IPR"), text("part"))).otherwise(F.concat(F.lit("INTERPRO:IPR"), F.lpad(text("part"), 6, "0"))).alias("domain_type_id"),
        F.when(k % 11 == 0, F.lit("PFAM")).when(k % 13 == 0, F.lit("odd")).otherwise("INTERPRO").alias("label_db"),
        F.when(k % 17 == 0, F.lit("n/a")).when(k % 19 == 0, text(-F.col("start"))).otherwise(text("start")).alias("start"),
        F.when(k % 23 == 0, text(F.col("start") - 1)).otherwise(text(F.col("end") + 1)).alias("end"),
        F.concat_ws(";", F.concat(F.lit("GO:"), F.lpad(text("part"), 7, "0")), F.when(k % 9 == 0, F.lit("GO:12"))).alias("go_terms"),
        F.when(k % 8 == 0, F.concat(F.lit("CHEBI:CHEBI:"), text("supp"))).otherwise(F.concat(F.lit("CHEBI:"), text("supp"))).alias("binding_target_chebi"),
        F.when(k % 10 == 0, "DOP:000001 Nterminal").when(k % 29 == 0, "DOF:12 odd").otherwise("DOF:000002 catalytic").alias("function_tags"),
        F.when(k % 21 == 0, "IPR12").otherwise(F.concat(F.lit("IPR"), F.lpad(text("part"), 6, "0"))).alias("interpro_id"),
        F.when(k % 25 == 0, "PR:1").otherwise(F.concat(F.lit("PR:"), F.lpad(text("part"), 9, "0"))).alias("xref_pro"),
        F.when(k % 27 == 0, "lig_x").otherwise("LIG_x;MOD_y").alias("xref_elm"),
        F.when(k % 12 == 0, "DOF:000009 kinase;XYZ:1").otherwise("DOP:000003 Cterminal").alias("positional_category"),
        F.when(k % 3 == 0, "DOP").otherwise("DOF").alias("namespace"),
        F.when(k % 15 == 0, "hsa:1").otherwise("R-HSA-1").alias("reactome_ids"), F.when(k % 15 == 1, "HSA:1").otherwise("hsa:04024").alias("kegg_ids"),
        "line", "status",
    )


K = "(part + supp)"
CHECKED = f"""{OCC}, v AS (SELECT *, part + supp AS k FROM occ)"""


def row_rules() -> list[rl.RowRule]:
    return [
        rl.blank_key("O2", "protein_accession"),
        rl.bad_format("T4", "domain_type_id", "domain_type"),
        rl.bad_format("O5", "protein_accession", "accession"),
        rl.not_in_list("T5a", "label_db", ["INTERPRO", "PFAM"]),
        rl.prefix_mismatch("T5b", "domain_type_id", "label_db"),
        rl.bad_span("O6", "start", "end"),
        rl.bad_tokens("O14", {"go": split_cell("go_terms")}, "go"),
        rl.double_chebi("O13", split_cell("binding_target_chebi")),
        rl.bad_tokens("O15", {"reactome": split_cell("reactome_ids")}, "reactome"),
        rl.bad_tokens("O16", {"kegg": split_cell("kegg_ids")}, "kegg"),
        rl.namespace_mismatch("A5", "function_tags", "namespace"),
        rl.wrong_column("O18", {"function_tags": split_cell("function_tags"), "positional_category": split_cell("positional_category")}),
        rl.single_value("R007", {"protein": split_cell("protein_accession"), "type": split_cell("domain_type_id")}),
        rl.unknown_prefix("R012", split_cell("positional_category")),
        rl.bad_tokens("A4", {"tags": split_cell("function_tags")}, "annotation"),
        rl.bad_tokens("A6", {"pro": split_cell("xref_pro")}, "pro"),
        rl.bad_tokens("A7", {"elm": split_cell("xref_elm")}, "elm"),
        rl.bad_format("T6", "interpro_id", "interpro"),
    ]


def book() -> rl.RuleBook:
    rules = rl.RuleBook()
    rules.add(*row_rules())

    @rules.register("O3a", hint="keep one row per key")
    def _(tables):
        return rl.duplicate_key(tables["checked"], ["protein", "line"], "key")

    @rules.register("O3b", "WARN")
    def _(tables):
        return rl.duplicate_row(tables["checked"].select("key", "protein", "line", "status"), "key")

    @rules.register("R001")
    def _(tables):
        tokens = tables["checked"].select(F.col("key").alias("row_id"), F.lit("position").alias("term_type"), F.explode(split_cell("positional_category")).alias("token"))
        index = tokens.sparkSession.createDataFrame([("position", "Cterminal")], "term_type string, form string")
        return rl.outside_vocabulary(tokens, index, "row_id", "DOP")

    return rules


RULE_SQL = [
    ("O2", "k % 50 = 0", "FAIL"), ("T4", "k % 7 = 0", "FAIL"), ("T5a", "k % 11 <> 0 AND k % 13 = 0", "FAIL"),
    ("T5b", "k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0", "FAIL"),
    ("O5", "k % 50 <> 0 AND k % 31 = 0", "FAIL"),
    ("O6", "k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0", "FAIL"), ("O14", "k % 9 = 0", "FAIL"), ("O13", "k % 8 = 0", "WARN"),
    ("O15", "k % 15 = 0", "FAIL"), ("O16", "k % 15 = 1", "FAIL"), ("A5", "(k % 10 = 0) <> (k % 3 = 0)", "FAIL"),
    ("O18", "k % 10 = 0 OR k % 12 = 0", "FAIL"), ("R007", "k % 50 = 0", "FAIL"), ("R012", "k % 12 = 0", "WARN"), ("A4", "k % 29 = 0 AND k % 10 <> 0", "FAIL"),
    ("A6", "k % 25 = 0", "FAIL"), ("A7", "k % 27 = 0", "FAIL"), ("T6", "k % 21 = 0", "FAIL"),
]
# The rule groups as queries of their own: checks of each group with the SQL of their reasons.
RULE_GROUPS = {
    "q02_blank_key": {"O2": "'protein_accession is blank'"},
    "q05_vocabulary_ids": {"A4": "'not annotation: DOF:12 odd'"},
    "q06_namespace_column": {"A5": "'namespace differs from the identifier prefix'"},
    "q07_pro_and_elm_tokens": {"A6": "'not pro: PR:1'", "A7": "'not elm: lig_x'"},
    "q08_type_ids": {"T4": "'domain_type_id is not a valid domain_type identifier'"},
    "q09_source_db": {"T5a": "'label_db is not an accepted value'", "T5b": "'identifier prefix differs from the source database'"},
    "q10_interpro_ids": {"T6": "'interpro_id is not a valid interpro identifier'"},
    "q11_go_tokens": {"O14": "'not go: GO:12'"},
    "q14_accessions": {"O5": "'protein_accession is not a valid accession identifier'"},
    "q16_double_chebi": {"O13": "'repeated CHEBI prefix'"},
    "q17_reactome_and_kegg": {"O15": "'not reactome: hsa:1'", "O16": "'not kegg: HSA:1'"},
    "q18_wrong_column": {"O18": "concat_ws('; ', CASE WHEN k % 10 = 0 THEN 'DOP term in function_tags' END, CASE WHEN k % 12 = 0 THEN 'DOF term in positional_category' END)"},
    "q21_single_value": {"R007": "'protein must hold one value'"},
    "q22_unknown_prefix": {"R012": "'unknown prefix: XYZ:1'"},
}


def _rule_query(name: str, checks: dict[str, str]) -> None:
    holds = {i: c for i, c, _ in RULE_SQL}
    parts = " UNION ALL ".join(f"SELECT '{i}' AS check_id, key AS row_id, {reason} AS reason FROM v WHERE {holds[i]}" for i, reason in checks.items())

    @query(name, f"WITH {CHECKED} {parts}")
    def run(spark, sf):
        return rl.row_violations(checked(spark, sf), "key", [r for r in row_rules() if r.check_id in checks])


for _group, _checks in RULE_GROUPS.items():
    _rule_query(_group, _checks)


PLAN_SQL = """
  SELECT 'O3a' AS check_id, key AS row_id FROM v QUALIFY count(*) OVER (PARTITION BY protein, line) > 1
  UNION ALL SELECT 'O3b', key FROM v QUALIFY count(*) OVER (PARTITION BY protein, line, status) > 1
  UNION ALL SELECT 'R001', key FROM v WHERE k % 12 = 0 UNION ALL SELECT 'R001', key FROM v WHERE k % 12 = 0"""
FLAGGED = CHECKED + ", flagged AS (" + " UNION ALL ".join(f"SELECT '{i}' AS check_id, key AS row_id FROM v WHERE {c}" for i, c, _ in RULE_SQL) + f" UNION ALL (SELECT * FROM ({PLAN_SQL})))"
LISTED = "(VALUES " + ", ".join(f"('{i}', '{s}', '')" for i, _, s in RULE_SQL) + ", ('O3a', 'FAIL', 'keep one row per key'), ('O3b', 'WARN', ''), ('R001', 'FAIL', '')) r(check_id, severity, hint)"


@query("q_x01_rule_report", f"""WITH {FLAGGED}
SELECT check_id, severity, hint, coalesce(n, 0) AS n_issues, CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE severity END AS status
FROM {LISTED} LEFT JOIN (SELECT check_id, count(*) AS n FROM flagged GROUP BY 1) USING (check_id)""")
def rule_report(spark, sf):
    return rl.run_rules({"checked": checked(spark, sf)}, book(), "checked", "key")[0]


@query("q_x01_flagged_rows", f"WITH {FLAGGED} SELECT check_id, row_id FROM flagged")
def flagged_rows(spark, sf):
    return rl.run_rules({"checked": checked(spark, sf)}, book(), "checked", "key")[1].select("check_id", "row_id")


@query("q25_status_summary", f"""WITH {FLAGGED}, rep AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE severity END AS status, coalesce(n, 0) AS n
FROM {LISTED} LEFT JOIN (SELECT check_id, count(*) AS n FROM flagged GROUP BY 1) USING (check_id))
SELECT status, count(*) AS n_checks, CAST(sum(n) AS BIGINT) AS n_issues FROM rep GROUP BY 1""")
def status_summary(spark, sf):
    return rl.status_summary(rule_report(spark, sf))


@query("a24_rule_metrics", f"""WITH {FLAGGED}, rep AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'PASS' ELSE severity END AS status FROM {LISTED} LEFT JOIN (SELECT check_id, count(*) AS n FROM flagged GROUP BY 1) USING (check_id))
SELECT 'n_rules' AS metric, count(*) AS value FROM rep UNION ALL SELECT 'rules_failing', count(*) FILTER (WHERE status = 'FAIL') FROM rep UNION ALL SELECT 'rules_passing', count(*) FILTER (WHERE status = 'PASS') FROM rep""")
def rule_metrics(spark, sf):
    return rl.rule_metrics(rule_report(spark, sf))


@query("q15_span_reasons", f"""WITH {CHECKED}, s AS (SELECT key, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN -start ELSE start END AS s, CASE WHEN k % 23 = 0 THEN start - 1 ELSE "end" + 1 END AS e FROM v),
r AS (SELECT key AS row_id, concat_ws('; ', CASE WHEN s IS NULL THEN 'start is not an integer' END, CASE WHEN s <= 0 THEN 'start is not positive' END, CASE WHEN e <= 0 THEN 'end is not positive' END, CASE WHEN s >= e THEN 'start is not below end' END) AS reason FROM s)
SELECT 'R008' AS check_id, row_id, reason FROM r WHERE reason <> ''""")
def span_reasons(spark, sf):
    return rl.row_violations(checked(spark, sf), "key", [rl.bad_span("R008", "start", "end")])


@query("q03_w11_duplicate_keys", """SELECT CAST(o_orderkey AS VARCHAR) AS row_id FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) > 1""")
def duplicate_keys(spark, sf):
    return rl.duplicate_key(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey").select(text("row_id").alias("row_id"))


@query("q04_duplicate_rows", """WITH r AS (SELECT page_id AS row_id, url, html FROM pages UNION ALL SELECT page_id + 1000000, url || '?copy', html FROM pages WHERE page_id % 10 = 0)
SELECT row_id FROM r QUALIFY count(*) OVER (PARTITION BY html) > 1""")
def duplicate_rows(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    copies = pages.filter("page_id % 10 = 0").withColumns({"page_id": F.col("page_id") + 1000000, "url": F.concat("url", F.lit("?copy"))})
    return rl.duplicate_row(pages.unionByName(copies), "page_id", ["url"]).select("row_id")


@query("q12_outside_vocabulary", f"WITH {CELLS} SELECT CAST(p_partkey AS VARCHAR) AS row_id, 'not in vocabulary: ' || t AS reason FROM m WHERE c = 'brand_cell' AND (mapped IS NULL OR (has AND CAST(n AS INT) % 4 = 0))")
def outside_vocabulary(spark, sf):
    return rl.outside_vocabulary(brand_tokens(spark, sf), vc.vocab_index(vocabulary(spark, sf)), "row_id")


@query("q19_namespace_tokens", f"""WITH {CELLS} SELECT CAST(p_partkey AS VARCHAR) AS row_id, CASE WHEN has THEN 'wrong namespace: ' ELSE 'unrecognised: ' END || t AS reason
FROM m WHERE c = 'brand_cell' AND (has OR mapped IS NULL)""")
def namespace_tokens(spark, sf):
    return rl.outside_vocabulary(brand_tokens(spark, sf), vc.vocab_index(vocabulary(spark, sf)), "row_id", "DOP")


@query("q20_foreign_terms", """SELECT CAST(p_partkey AS VARCHAR) AS row_id, 'foreign term: ' || p_type AS reason FROM part WHERE p_type IN ('SMALL', 'LARGE')""")
def foreign_terms(spark, sf):
    tokens = table(spark, sf, "part").select(text("p_partkey").alias("row_id"), F.lit("type").alias("column_name"), F.col("p_type").alias("token"))
    forbidden = table(spark, sf, "part").filter("p_type in ('SMALL', 'LARGE')").select(F.lit("type").alias("column_name"), F.lower("p_type").alias("form")).distinct()
    return rl.foreign_vocabulary(tokens, forbidden, "row_id")


@query("q01_column_check", """
SELECT t.*, CASE WHEN present THEN n END AS n_filled FROM (VALUES ('core', 'o_orderkey', TRUE), ('core', 'o_missing', FALSE), ('soft', 'o_custkey', TRUE)) t(tier, column_name, present), (SELECT count(*) AS n FROM orders)""")
def column_check(spark, sf):
    from annospan.operators.compare import profile
    from annospan.operators.reshape import column_check as check

    orders = table(spark, sf, "orders")
    filled = profile(orders, ["o_orderkey", "o_custkey"]).select("column_name", "n_filled")
    return check(orders, {"core": ["o_orderkey", "o_missing"], "soft": ["o_custkey"]}).join(filled, "column_name", "left")
