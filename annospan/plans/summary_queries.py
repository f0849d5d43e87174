"""Aggregations, top-k reports, fixed questions, network, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.functions.cells import split_cell, split_multi
from annospan.functions.formats import FORMATS
from annospan.operators import reshape, summaries as sm
from annospan.plans.base import OCC, occurrences, query, table, text


def tagged(spark, sf):
    """Occurrences with token cells: tags, targets, pathways."""
    return occurrences(spark, sf).withColumns({
        "function_tags": F.concat_ws(";", F.concat(F.lit("role_"), F.col("flag")), F.split("pname", " ")[0]),
        "targets": F.when(F.col("status") == "F", F.concat_ws(";", F.concat(F.lit("CHEBI:"), text(F.col("supp") % 20)), F.concat(F.lit("CHEBI:"), text(F.col("part") % 11)))).otherwise(""),
        "pathways": F.concat_ws(";", F.concat(F.lit("R-HSA-"), text(F.col("supp") % 9)), F.concat(F.lit("R-HSA-"), text(F.col("line")))),
    })


TAGGED = f"""{OCC},
tagged AS (
  SELECT *, 'role_' || flag || ';' || split_part(pname, ' ', 1) AS function_tags,
    CASE WHEN status = 'F' THEN 'CHEBI:' || (supp % 20) || ';CHEBI:' || (part % 11) ELSE '' END AS targets,
    'R-HSA-' || (supp % 9) || ';R-HSA-' || line AS pathways FROM occ),
tags AS (SELECT protein, acc, key, unnest(string_split(function_tags, ';')) AS t FROM tagged),
tgts AS (SELECT protein, acc, key, unnest(string_split(targets, ';')) AS t FROM tagged WHERE targets <> ''),
paths AS (SELECT protein, acc, key, unnest(string_split(pathways, ';')) AS t FROM tagged)"""


@query("a01_a07_type_summary", f"""WITH {TAGGED},
n AS (SELECT acc, count(*) AS n_occurrences, count(DISTINCT protein) AS n_proteins, count(DISTINCT supp) AS n_genes,
        round(avg("end" - start + 1), 2) AS mean_domain_length, round(quantile_cont("end" - start + 1, 0.5), 2) AS median_domain_length,
        CAST(min("end" - start + 1) AS BIGINT) AS min_domain_length, CAST(max("end" - start + 1) AS BIGINT) AS max_domain_length FROM occ GROUP BY acc),
prot AS (SELECT acc, string_agg(p, ', ' ORDER BY p) || CASE WHEN max(c) > 50 THEN ', ... (+' || (max(c) - 50) || ' more)' ELSE '' END AS protein_accessions
  FROM (SELECT acc, CAST(protein AS VARCHAR) AS p, row_number() OVER (PARTITION BY acc ORDER BY CAST(protein AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY acc) AS c
        FROM (SELECT DISTINCT acc, protein FROM occ)) WHERE rn <= 50 GROUP BY acc),
tal AS (SELECT acc, string_agg(t || ':' || c, '; ' ORDER BY -c, t) AS function_tags_counts FROM (SELECT acc, t, count(*) AS c FROM tags GROUP BY acc, t) GROUP BY acc),
uni AS (SELECT acc, string_agg(t, '; ' ORDER BY t) AS targets_union FROM (SELECT DISTINCT acc, t FROM tgts) GROUP BY acc),
nm AS (SELECT acc, arg_min(label, (-c, label)) AS domain_name FROM (SELECT acc, label, count(*) AS c FROM occ GROUP BY acc, label) GROUP BY acc),
cp AS (SELECT acc, string_agg(c || ':' || n, '; ' ORDER BY c) AS copy_number_profile FROM (SELECT acc, c, count(*) AS n FROM
       (SELECT acc, protein, count(*) AS c FROM occ GROUP BY acc, protein) GROUP BY acc, c) GROUP BY acc)
SELECT acc AS domain_type_id, n_occurrences, n_proteins, n_genes, mean_domain_length, median_domain_length, min_domain_length, max_domain_length,
  protein_accessions, function_tags_counts, targets_union, copy_number_profile, domain_name
FROM n JOIN prot USING (acc) JOIN tal USING (acc) JOIN uni USING (acc) JOIN nm USING (acc) JOIN cp USING (acc)""")
def type_summary(spark, sf):
    from annospan.operators.intervals import copy_number

    occ = copy_number(tagged(spark, sf)).withColumnRenamed("acc", "domain_type_id").withColumns({"gene": text("supp"), "protein": text("protein")})
    return sm.summarise_types(occ, tallies=["function_tags"], unions=["targets"], copies="copy_number")


@query("a02_copy_profile", f"""WITH {OCC}
SELECT acc, string_agg(c || ':' || n, '; ' ORDER BY c) AS copy_number_profile FROM (SELECT acc, c, count(*) AS n FROM
  (SELECT acc, protein, count(*) AS c FROM occ GROUP BY acc, protein) GROUP BY acc, c) GROUP BY acc""")
def copy_profile(spark, sf):
    from annospan.operators.intervals import copy_number

    return sm.copy_profile(copy_number(occurrences(spark, sf)), "acc", "protein", "copy_number")


@query("a03_type_cooccurrence", f"""WITH {OCC}, d AS (SELECT DISTINCT protein, acc FROM occ)
SELECT x.acc AS domain_a, y.acc AS domain_b, count(*) AS protein_count FROM d x JOIN d y ON x.protein = y.protein AND x.acc < y.acc
GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence(spark, sf):
    pairs = reshape.entity_feature_pairs(occurrences(spark, sf), "protein", "acc")
    return sm.cooccurrence(pairs, "protein", "acc", min_support=2)


@query("a04_order_pairs", f"""WITH {OCC},
n AS (SELECT protein, acc AS first_type, lead(acc) OVER (PARTITION BY protein ORDER BY start, "end", part, supp) AS second_type FROM occ)
SELECT first_type, second_type, count(*) AS occurrence_support, count(DISTINCT protein) AS protein_support
FROM n WHERE second_type IS NOT NULL GROUP BY 1, 2""")
def order_pairs(spark, sf):
    from annospan.operators.intervals import coordinate_bin

    return sm.order_pairs(occurrences(spark, sf), "protein", "acc", ["start", "end", "part", "supp"], coordinate_bin("start"))


@query("a04_chain_text", f"""WITH {OCC}
SELECT protein, string_agg(acc, ' > ' ORDER BY start, "end", part, supp) AS chain FROM occ GROUP BY protein""")
def chain(spark, sf):
    return sm.chain_text(occurrences(spark, sf), "protein", "acc", ["start", "end", "part", "supp"])


@query("a05_tally", f"""WITH {TAGGED},
f AS (SELECT acc, unnest(CASE WHEN targets = '' THEN ['unknown'] ELSE string_split(targets, ';') END) AS t FROM tagged)
SELECT acc, string_agg(t || ':' || c, '; ' ORDER BY -c, t) AS target_counts FROM (SELECT acc, t, count(*) AS c FROM f GROUP BY acc, t) GROUP BY acc""")
def tally(spark, sf):
    return sm.tally(tagged(spark, sf), "acc", split_multi("targets"), "target_counts")


@query("a06_token_union", f"""WITH {TAGGED}
SELECT protein, string_agg(t, '; ' ORDER BY t) AS pathway_union FROM (
  SELECT protein, t, row_number() OVER (PARTITION BY protein ORDER BY t) AS rn FROM (SELECT DISTINCT protein, t FROM paths)) WHERE rn <= 5 GROUP BY protein""")
def token_union(spark, sf):
    return sm.token_union(tagged(spark, sf), "protein", split_multi("pathways"), "pathway_union", max_items=5)


@query("a08_type_dimension", """
WITH e AS (SELECT p_brand, p_partkey AS pos, 0 AS src, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS tags FROM part),
o AS (SELECT p_brand, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS pos, 1 AS src, p_name AS name, l_returnflag AS tags FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT * FROM e UNION ALL SELECT * FROM o)
SELECT p_brand, arg_min(name, (src, pos)) FILTER (WHERE name IS NOT NULL) AS name, arg_min(tags, (src, pos)) FILTER (WHERE tags IS NOT NULL) AS tags FROM b GROUP BY p_brand""")
def type_dimension(spark, sf):
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    k = F.col("p_partkey")
    entries = part.select(
        "p_brand", F.when(k % 3 == 0, None).otherwise(F.col("p_name")).alias("name"), F.when(k % 5 == 0, F.col("p_type")).alias("tags"), k.alias("pos")
    )
    occ = line.join(part, F.col("l_partkey") == k).select(
        "p_brand", F.col("p_name").alias("name"), F.col("l_returnflag").alias("tags"),
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("pos"),
    )
    return sm.build_types(entries, occ, "p_brand", ["name", "tags"], "pos")


@query("a09_type_merge", """
SELECT p_brand, p_name AS name, p_type AS description, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name DESC, p_type DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def type_merge(spark, sf):
    part = table(spark, sf, "part").select("p_brand", F.col("p_name").alias("name"), F.col("p_type").alias("description"), "p_partkey")
    return sm.merge_types(part, "p_brand", ["name", "description"], ["p_partkey"])


@query("a10_dedup_richest", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS status FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flag, status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY -((flag <> '')::INT + (status IS NOT NULL)::INT), l_partkey, l_suppkey) AS rn FROM r) WHERE rn = 1""")
def dedup_richest(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("status"),
    )
    return sm.dedup_richest(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("a10_duplicate_report", """
WITH k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_suppkey, count(*) AS duplicate_rows FROM k WHERE n > 1 GROUP BY l_suppkey""")
def duplicate_report(spark, sf):
    return sm.duplicate_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


@query("a11_dedup_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sm.dedup_first(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("w11_duplicate_flag", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem""")
def dup_mask(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sm.dup_mask(line, ["l_orderkey", "l_linenumber"])


@query("a12_protein_table", """
SELECT o_custkey AS protein, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS gene_symbol, count(*) AS n_domains,
  coalesce(any_value(c_mktsegment), 'other') AS protein_group, CASE any_value(c_mktsegment) WHEN 'BUILDING' THEN 'kinase' ELSE 'other' END AS family_module
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""")
def protein_table(spark, sf):
    from annospan.functions.cells import module_of

    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("protein"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("gene")
    )
    groups = table(spark, sf, "customer").select(F.col("c_custkey").alias("protein"), F.col("c_mktsegment").alias("protein_group"))
    return sm.protein_table(orders, "protein", "gene", groups, module_of("protein_group", {"BUILDING": "kinase"}), "o_orderkey")


@query("a13_support", f"""WITH {OCC} SELECT acc, count(DISTINCT protein) AS n_entities FROM occ GROUP BY acc""")
def support(spark, sf):
    return sm.support(occurrences(spark, sf), "protein", "acc")


@query("a14_features", f"""WITH {TAGGED}, f AS (
  SELECT protein, 'function_tags::' || t AS feature FROM tags UNION ALL SELECT protein, 'targets::' || t FROM tgts)
SELECT protein, feature, count(*) AS n FROM f GROUP BY 1, 2""")
def feature_counts(spark, sf):
    return sm.features(tagged(spark, sf), "protein", {"function_tags": split_cell("function_tags"), "targets": split_cell("targets")})


@query("a15_k04_crosstab_top", f"""WITH {TAGGED},
c AS (SELECT acc, t, count(*) AS n FROM tgts GROUP BY 1, 2),
r AS (SELECT acc FROM c GROUP BY acc ORDER BY sum(n) DESC, acc LIMIT 10), k AS (SELECT c.* FROM c SEMI JOIN r USING (acc)),
l AS (SELECT t FROM k GROUP BY t ORDER BY sum(n) DESC, t LIMIT 8)
SELECT acc, t AS target, n FROM k SEMI JOIN l USING (t)""")
def crosstab(spark, sf):
    long = tagged(spark, sf).select("acc", F.explode(split_cell("targets")).alias("target"))
    return sm.crosstab_top(long, "acc", "target", rows=10, cols=8)


@query("a16_diversity", f"""WITH {TAGGED} SELECT acc, count(DISTINCT t) AS n_targets FROM tgts GROUP BY acc ORDER BY n_targets DESC, acc LIMIT 30""")
def diversity(spark, sf):
    return sm.diversity(tagged(spark, sf).select("acc", F.explode(split_cell("targets")).alias("t")), "acc", "t")


@query("a17_token_frequency", f"""WITH {TAGGED} SELECT t AS token, count(*) AS n FROM tags GROUP BY t ORDER BY n DESC, t LIMIT 30""")
def token_frequency(spark, sf):
    return sm.token_frequency(tagged(spark, sf), split_cell("function_tags"))


@query("a18_target_connectivity", f"""WITH {TAGGED} SELECT t AS token, count(DISTINCT key) AS n FROM tgts GROUP BY t ORDER BY n DESC, t LIMIT 30""")
def target_connectivity(spark, sf):
    return sm.target_connectivity(tagged(spark, sf), split_cell("targets"))


@query("a19_cq01_tagged_types", f"""WITH {TAGGED} SELECT DISTINCT protein, acc, t AS tag FROM tags""")
def cq01(spark, sf):
    return sm.tagged_types(tagged(spark, sf), "protein", "acc", split_cell("function_tags"), "tag")


@query("a20_cq03_pathway_support", f"""WITH {TAGGED} SELECT t AS pathway, acc, count(DISTINCT protein) AS protein_count FROM paths GROUP BY 1, 2""")
def cq03(spark, sf):
    return sm.type_pathway_support(tagged(spark, sf), "protein", "acc", split_cell("pathways"))


@query("a21_cq04_binding_targets", f"""WITH {TAGGED} SELECT DISTINCT t AS binding_target_chebi, protein, acc FROM tgts""")
def cq04(spark, sf):
    return sm.tagged_types(tagged(spark, sf), "protein", "acc", split_cell("targets"), "binding_target_chebi")


@query("a22_cq05_distribution", f"""WITH {TAGGED} SELECT t AS category, count(*) AS count FROM paths GROUP BY t""")
def cq05(spark, sf):
    return sm.token_distribution(tagged(spark, sf), split_cell("pathways"), "category")


@query("a23_x02_query_summary", f"""WITH {TAGGED}
SELECT 'cq01' AS query, count(*) AS n_rows, 'OK' AS status FROM (SELECT DISTINCT protein, acc, t FROM tags)
UNION ALL SELECT 'cq03', count(*), 'OK' FROM (SELECT DISTINCT t, acc FROM paths)
UNION ALL SELECT 'none', 0, 'EMPTY'""")
def query_summary(spark, sf):
    empty = occurrences(spark, sf).filter("flag = 'none'")
    return sm.query_summary({"cq01": cq01(spark, sf), "cq03": cq03(spark, sf), "none": empty})


@query("a24_summary_metrics", f"""WITH {TAGGED}
SELECT 'rows' AS metric, count(*) AS value FROM occ UNION ALL SELECT 'distinct_protein', count(DISTINCT protein) FROM occ
UNION ALL SELECT 'distinct_acc', count(DISTINCT acc) FROM occ
UNION ALL SELECT 'chebi_ids', count(DISTINCT t) FROM tgts UNION ALL SELECT 'reactome_ids', count(DISTINCT t) FROM paths""")
def summary_metrics(spark, sf):
    return sm.summary_metrics(tagged(spark, sf), ["protein", "acc"], {
        "chebi_ids": (split_cell("targets"), FORMATS["chebi"]), "reactome_ids": (split_cell("pathways"), FORMATS["reactome"]),
    })


EDGES = f"""{TAGGED},
links AS (SELECT key, 0 AS k, CAST(protein AS VARCHAR) AS a, acc AS b, 'has_domain' AS ty FROM occ UNION ALL
  SELECT key, 1, acc, t, 'has_function' FROM tags UNION ALL SELECT key, 2, acc, t, 'has_binding_target' FROM tgts),
edges AS (SELECT least(a, b) AS u, greatest(a, b) AS v, arg_max(ty, (key, k)) AS edge_type FROM links GROUP BY 1, 2)"""


@query("a25_network_edges", f"WITH {EDGES} SELECT u, v, edge_type FROM edges")
def network_edges(spark, sf):
    links = {"function_tag": ("has_function", split_cell("function_tags")), "binding_target": ("has_binding_target", split_cell("targets"))}
    return sm.network(tagged(spark, sf), "protein", "acc", links, ["key"])[1]


@query("a25_network_nodes", f"""WITH {EDGES},
n AS (SELECT key, 0 AS k, CAST(protein AS VARCHAR) AS node, 'protein' AS ty FROM occ UNION ALL SELECT key, 1, acc, 'domain_type' FROM occ
  UNION ALL SELECT key, 2, t, 'function_tag' FROM tags UNION ALL SELECT key, 3, t, 'binding_target' FROM tgts),
d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node)
SELECT node, arg_min(ty, (key, k)) AS node_type, coalesce(any_value(degree), 0) AS degree FROM n LEFT JOIN d USING (node) GROUP BY node""")
def network_nodes(spark, sf):
    links = {"function_tag": ("has_function", split_cell("function_tags")), "binding_target": ("has_binding_target", split_cell("targets"))}
    return sm.network(tagged(spark, sf), "protein", "acc", links, ["key"])[0]


@query("a34_protein_summary", """
SELECT o_custkey AS protein_accession, o_orderstatus AS status, o_orderpriority AS priority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def protein_summary(spark, sf):
    renames = {"o_custkey": "protein_accession", "o_orderstatus": "status", "o_orderpriority": "priority"}
    return sm.protein_summary(table(spark, sf, "orders"), renames, "o_custkey", "o_orderkey")


@query("k02_accession_sample", """
WITH d AS (SELECT DISTINCT p_type AS type, p_name AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name) AS rn, count(*) OVER (PARTITION BY type) AS c FROM d)
SELECT type, string_agg(name, ', ' ORDER BY name) || CASE WHEN max(c) > 10 THEN ', ... (+' || (max(c) - 10) || ' more)' ELSE '' END AS names FROM r WHERE rn <= 10 GROUP BY type""")
def accession_sample(spark, sf):
    return sm.sample_text(table(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name")), "type", "name", "names", 10)


@query("k03_top_k_per_group", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 10""")
def top_k(spark, sf):
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sm.top_k(line, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 10)


@query("k05_modal_value", """
SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def modal(spark, sf):
    return sm.modal(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("k06_argmax", """
SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey, max(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey""")
def argmax(spark, sf):
    return sm.argmax(table(spark, sf, "customer"), "c_custkey", "c_acctbal", ["c_nationkey"])


@query("k07_report_order", """
SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20""")
def report_order(spark, sf):
    return sm.top_values(table(spark, sf, "part"), "p_brand", 20)


# Reshaping -----------------------------------------------------------------


@query("p01_p03_canonicalise", """SELECT l_orderkey AS protein_accession, l_partkey AS part_id, l_quantity AS amount FROM lineitem""")
def canonicalise(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    out = reshape.canonicalise(line, {"protein_accession": ["accession", "l_orderkey"], "part_id": ["l_partkey"], "amount": ["l_quantity", "l_tax"]})
    reshape.require(out, ["protein_accession", "part_id"], ["amount"])
    return out


@query("p02_explode_tokens", """
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS position, string_split(p_name, ' ')[i] AS token FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def explode_tokens(spark, sf):
    return reshape.explode_tokens(table(spark, sf, "part"), "p_name", "p_partkey", " ")


RECORDS = """r AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS pos,
  CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE CAST(l_orderkey AS VARCHAR) END AS accession,
  CASE WHEN p_name LIKE '%widget%' THEN 'Putative ' || p_name ELSE p_name END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT *, CASE WHEN trim(accession) = '' THEN 'missing_accession'
  WHEN row_number() OVER (PARTITION BY accession ORDER BY pos) > 1 THEN 'duplicate_accession'
  WHEN regexp_matches(name, '(?i)hypothetical|putative|like') THEN 'excluded_by_name' END AS reason FROM r)"""


def records(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("pos"),
        F.when(F.col("l_suppkey") % 10 == 0, " ").otherwise(text("l_orderkey")).alias("accession"),
        F.when(F.col("p_name").contains("widget"), F.concat(F.lit("Putative "), "p_name")).otherwise(F.col("p_name")).alias("name"),
    )


@query("p04_records_kept", f"WITH {RECORDS} SELECT pos, accession, name FROM m WHERE reason IS NULL")
def records_kept(spark, sf):
    return reshape.filter_records(records(spark, sf), "accession", "name", ["pos"])[0].select("pos", "accession", "name")


@query("p04_records_dropped", f"WITH {RECORDS} SELECT pos, reason FROM m WHERE reason IS NOT NULL")
def records_dropped(spark, sf):
    return reshape.filter_records(records(spark, sf), "accession", "name", ["pos"])[1].select("pos", "reason")


@query("p05_with_coords", """
SELECT event_id, CAST(trunc(value) AS INTEGER) AS start, CAST(event_id % 100 AS INTEGER) AS "end" FROM events WHERE event_type <> 'error'""")
def with_coords(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(text("value")).alias("start"), text(F.col("event_id") % 100).alias("end")
    )
    return reshape.with_coords(ev)


@query("p06_foreground_pairs", f"WITH {OCC} SELECT DISTINCT protein, acc FROM occ")
def foreground_pairs(spark, sf):
    return reshape.entity_feature_pairs(occurrences(spark, sf), "protein", "acc")


@query("p07_label_template", """
SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, '' AS protein_group FROM orders GROUP BY o_custkey""")
def label_template(spark, sf):
    return reshape.label_template(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority"])


def annotated(spark, sf):
    return tagged(spark, sf).select(
        "protein", F.col("acc").alias("domain_type_id"), "function_tags", F.concat_ws(";", "flag", "status").alias("topology_context"),
        F.col("label").alias("positional_category"), F.col("targets").alias("binding_partner"),
    )


ANNOTATED = f"""{TAGGED},
long AS (SELECT protein, 'domain_type' AS annotation_category, 'hasDomainType' AS predicate, acc AS term_value FROM occ
  UNION ALL SELECT protein, 'function', 'hasFunctionTag', t FROM tags
  UNION ALL SELECT protein, 'topology', 'hasTopologyContext', unnest([flag, status]) FROM occ
  UNION ALL SELECT protein, 'position', 'hasPositionalCategory', label FROM occ
  UNION ALL SELECT protein, 'binding_target', 'hasBindingTarget', t FROM tgts)"""


@query("p08_p10_annotations_long", f"""WITH {ANNOTATED}
SELECT DISTINCT *, annotation_category <> 'binding_target' AS is_transferable FROM long""")
def annotations_long(spark, sf):
    return reshape.annotations_long(annotated(spark, sf), "protein")


@query("p09_annotations_structural", f"""WITH {ANNOTATED}
SELECT DISTINCT * FROM long WHERE annotation_category IN ('domain_type', 'topology', 'position', 'proximity')""")
def annotations_structural(spark, sf):
    return reshape.annotations_structural(annotated(spark, sf), "protein")


@query("p10_transfer_rules", """
WITH given AS (SELECT DISTINCT c_mktsegment AS annotation_category, c_mktsegment IN ('BUILDING', 'FURNITURE') AS is_transferable FROM customer),
base AS (SELECT * FROM (VALUES ('domain_type', TRUE), ('function', TRUE), ('topology', TRUE), ('position', TRUE), ('copy_number', TRUE), ('proximity', TRUE),
  ('binding_target', FALSE), ('GO_function', TRUE), ('GO_process', FALSE), ('GO_component', FALSE)) t(annotation_category, is_transferable))
SELECT * FROM given UNION ALL SELECT * FROM base""")
def transfer_rules(spark, sf):
    given = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("annotation_category"), F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "Yes").otherwise("no").alias("transferable")
    ).distinct()
    return reshape.load_rules(given, spark)


@query("p11_occurrence_links", f"""WITH {TAGGED}
SELECT key, t AS linked_id, 'CHEBI' AS linked_db, 'binding_target' AS link_type, status AS evidence FROM tgts JOIN occ USING (key)""")
def occurrence_links(spark, sf):
    return reshape.occurrence_links(tagged(spark, sf), "key", split_cell("targets"), "binding_target", F.col("status"))


@query("p12_approved_pairs", """
SELECT o_orderkey, o_totalprice / 100000 AS candidate_score, o_orderpriority AS curation_status FROM orders WHERE lower(o_orderpriority) IN ('yes') OR o_orderstatus = 'P'""")
def approved_pairs(spark, sf):
    pairs = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000).alias("candidate_score"), F.col("o_orderpriority").alias("curation_status"),
        F.when(F.col("o_orderstatus") == "P", "high_confidence").otherwise("probable").alias("confidence_tier"),
    )
    return reshape.approve_pairs(pairs).drop("confidence_tier")


@query("p13_restrict", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def restrict(spark, sf):
    keys = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return reshape.restrict(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("p14_cluster_flags", """
SELECT o_custkey, o_orderkey, n AS cluster_size, h AS has_human, m AS has_mouse, h AND m AS cross_species_cluster FROM orders JOIN
  (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS h, bool_or(o_orderstatus = 'P') AS m FROM orders GROUP BY o_custkey) USING (o_custkey)""")
def cluster_flags(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "human").when(F.col("o_orderstatus") == "P", "mouse").otherwise("yeast").alias("species")
    )
    return reshape.cluster_flags(orders, "o_custkey", "species").drop("species")


@query("p15_pair_headers", """SELECT o_orderkey AS human_accession, o_custkey AS other_accession, o_orderpriority AS gene_name FROM orders""")
def pair_headers(spark, sf):
    return reshape.load_pairs(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Human Protein"), F.col("o_custkey").alias("species2_accession"), F.col("o_orderpriority").alias("Gene Name")
    ))
