"""Readers, record parsers and sinks over texts that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.plans.base import OCC, occurrences, query, spread_table, table, text
from annospan.session import scratch_path
from annospan.sources import entries, flatfile, regions, sequences, tables
from annospan.streaming import landing


@query("s01_read_keys", """SELECT DISTINCT p_name AS gene FROM part""")
def read_keys(spark, sf):
    path = scratch_path(spark, "keys")
    lines = table(spark, sf, "part").select(F.concat(F.when(F.col("p_partkey") % 9 == 0, "# note ").otherwise(" "), "p_name", F.lit(" ")).alias("value"))
    lines.write.text(path)
    return tables.read_keys(spark, path).select("gene")


@query("s02_s20_read_table", """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders""")
def read_table(spark, sf):
    path = scratch_path(spark, "table")
    orders = table(spark, sf, "orders").select(
        text("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", "nan").otherwise(F.concat(F.lit(" "), "o_orderstatus")).alias("status"),
        F.array("o_orderpriority").alias("priority"),
    )
    tables.write_tsv(orders, path)
    return tables.read_table(spark, path, ["key", "status", "priority"])


@query("s03_scan_partitions", """SELECT o_orderpriority[1] AS gene, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders""")
def scan_partitions(spark, sf):
    path = scratch_path(spark, "parts")
    table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("g"), text("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).write.partitionBy("g").option("sep", "\t").option("header", True).csv(path)
    return tables.scan_partitions(spark, f"{path}/g=*/*.csv", ["key", "status"], r"/g=([^/]+)/").drop("source_file")


@query("s04_schema_tolerant_union", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '' AS note, c_mktsegment AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', '' FROM supplier""")
def tolerant_union(spark, sf):
    a = table(spark, sf, "customer").select(text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(text("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tables.union_all([a, b], ["id", "note"])


def records(spark, sf):
    """A flat-file record per order: names, references, comments, features, sequence."""
    occ = occurrences(spark, sf)
    refs = F.concat(F.lit("DR   Pfam; PF"), text("part"), F.lit("; x.\nDR   GO; GO:"), text("supp"), F.lit("; "), F.when(F.col("flag") == "R", "F").otherwise("P"), F.lit(":y; z.\n"))
    feats = F.concat(
        F.lit("FT   "), F.when(F.col("flag") == "R", "REGION").otherwise("DOMAIN"), F.lit("          "), text("start"), F.lit(".."), text("end"),
        F.lit('\nFT                   /note="'), "pname", F.lit('"\nFT                   /ligand_id="ChEBI:'), text("supp"), F.lit('"\nFT                   more text\n'),
    )
    item = F.struct("key", refs.alias("r"), feats.alias("f"))
    per = occ.groupBy("protein").agg(F.sort_array(F.collect_list(item)).alias("x"), F.min("pname").alias("n"), F.min("acc").alias("g"))
    lines = lambda f: F.array_join(F.transform("x", lambda e: e[f]), "")
    return per.select("protein", F.concat(
        F.lit("ID   P"), text("protein"), F.lit("_HUMAN   Reviewed;\nDE   RecName: Full="), "n", F.lit(";\nGN   Name="), "g", F.lit("; Synonyms=syn1, syn2;\n"),
        lines("r"), F.lit("CC   -!- FUNCTION: Acts on "), "n", F.lit("\nCC       and more.\nCC   -!- SUBUNIT: Binds "), "g", F.lit(".\n"), lines("f"),
        F.lit("SQ   SEQUENCE   12 AA;  1 MW;\n     ACDEF GHIKL\n     MN\n"),
    ).alias("record"))


@query("s05_parse_records", f"""WITH {OCC} SELECT protein, 'P' || protein || '_HUMAN' AS entry_id, min(pname) AS protein_name, min(acc) || ';syn1;syn2' AS genes, 'ACDEFGHIKLMN' AS sequence, CAST(12 AS INTEGER) AS protein_length FROM occ GROUP BY protein""")
def parse_records(spark, sf):
    return flatfile.parse_records(records(spark, sf)).drop("record")


@query("s05_read_flatfile", f"""WITH {OCC} SELECT 'P' || protein || '_HUMAN' AS entry_id, CAST(12 AS INTEGER) AS protein_length, CAST(count(*) AS INTEGER) AS n_features FROM occ GROUP BY protein""")
def read_flatfile(spark, sf):
    path = scratch_path(spark, "flat")
    records(spark, sf).select(F.concat("record", F.lit("//")).alias("value")).write.text(path)
    parsed = flatfile.flat_features(flatfile.parse_records(flatfile.read_flatfile(spark, path)))
    return parsed.select("entry_id", "protein_length", "n_features")


@query("s06_cross_references", f"""WITH {OCC} SELECT protein, string_agg('PF' || part, ';' ORDER BY key) AS pfam, string_agg(DISTINCT 'GO:' || supp, ';' ORDER BY 'GO:' || supp) AS go,
  coalesce(string_agg(DISTINCT 'GO:' || supp, ';' ORDER BY 'GO:' || supp) FILTER (WHERE flag = 'R'), '') AS go_mf, coalesce(string_agg(DISTINCT 'GO:' || supp, ';' ORDER BY 'GO:' || supp) FILTER (WHERE flag <> 'R'), '') AS go_bp FROM occ GROUP BY protein""")
def cross_references(spark, sf):
    out = flatfile.flat_xrefs(records(spark, sf))
    names = {"pfam": "pfam_ids", "go": "go_ids", "go_mf": "go_mf_ids", "go_bp": "go_bp_ids"}
    return out.select("protein", *[F.array_join(c, ";").alias(n) for n, c in names.items()])


@query("s07_comments", f"""WITH {OCC} SELECT protein, 'Acts on ' || min(pname) || ' and more.' AS cc_function, 'Binds ' || min(acc) || '.' AS cc_subunit, '' AS cc_cofactor FROM occ GROUP BY protein""")
def comments(spark, sf):
    return flatfile.flat_comments(records(spark, sf)).select("protein", "cc_function", "cc_subunit", "cc_cofactor")


@query("s08_feature_table", f"""WITH {OCC} SELECT protein, CAST(row_number() OVER (PARTITION BY protein ORDER BY key) - 1 AS INTEGER) AS position, CASE WHEN flag = 'R' THEN 'REGION' ELSE 'DOMAIN' END AS ftype, start AS fstart, "end" AS fend,
  pname || ' more text' AS note, 'ChEBI:' || supp AS ligand FROM occ""")
def feature_table(spark, sf):
    out = flatfile.feature_table(flatfile.flat_features(records(spark, sf)), "protein")
    return out.select("protein", "position", "ftype", "fstart", "fend", "note", F.element_at("qualifiers", "ligand_id")[0].alias("ligand"))


@query("s08_feature_counts", f"""WITH {OCC} SELECT protein, CAST(count(*) FILTER (WHERE flag = 'R') AS INTEGER) AS region_count, CAST(count(*) FILTER (WHERE flag <> 'R') AS INTEGER) AS domain_count FROM occ GROUP BY protein""")
def feature_counts(spark, sf):
    return flatfile.flat_features(records(spark, sf)).select("protein", "region_count", "domain_count")


def entry_json(spark, sf):
    """A domain entry per line: two fragments for long lines, member databases, GO terms."""
    occ = occurrences(spark, sf, spread_table)
    frag = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    long = F.col("end") - F.col("start") >= 30
    frags = F.when(long, F.array(frag(F.col("start"), F.col("start") + 9), frag(F.col("end") - 9, F.col("end")))).otherwise(F.array(frag(F.col("start"), F.col("end"))))
    meta = F.struct(
        F.when(F.col("flag") == "R", F.concat(F.lit("G3DSA:1.10."), text(F.col("part") % 9), F.lit("."), text(F.col("supp") % 9))).otherwise(F.col("acc")).alias("accession"),
        F.col("pname").alias("name"), F.when(F.col("status") == "F", "Domain").otherwise("family").alias("type"),
        F.when(F.col("flag") == "R", "cathgene3d").otherwise("InterPro").alias("source_database"), F.lit("  a   b ").alias("description"),
        F.array(F.struct(F.concat(F.lit("GO:"), text("supp")).alias("identifier"), F.struct(F.lit("F").alias("code"), F.lit("molecular_function").alias("name")).alias("category"))).alias("go_terms"),
        F.create_map(F.lit("pfam"), F.create_map(F.concat(F.lit("PF"), text("part")), F.col("label"))).alias("member_databases"),
    )
    proteins = F.array(F.struct(F.concat(F.lit("p"), text("protein")).alias("accession"), F.array(F.struct(frags.alias("fragments"))).alias("entry_protein_locations")))
    body = F.to_json(F.struct(meta.alias("metadata"), proteins.alias("proteins")))
    return entries.parse_entries(occ.select("key", F.concat(F.lit("P"), text("protein")).alias("accession"), body.alias("entry"), F.col("flag"), F.col("status")))


E_RANGES = """CASE WHEN "end" - start >= 30 THEN start || '..' || (start + 9) || ';' || ("end" - 9) || '..' || "end" ELSE start || '..' || "end" END"""


@query("s09_domain_entries", f"""WITH {OCC} SELECT 'P' || protein AS accession, CASE WHEN flag = 'R' THEN 'G3DSA:1.10.' || (part % 9) || '.' || (supp % 9) ELSE acc END AS entry, pname AS name, start, "end", {E_RANGES} AS ranges,
  CAST(CASE WHEN "end" - start >= 30 THEN 2 ELSE 1 END AS INTEGER) AS n_fragments, 'GO:' || supp AS go_terms_mf, '' AS go_terms_bp, 'a b' AS description FROM occ WHERE status = 'F'""")
def domain_entries(spark, sf):
    return entries.entries_to_domains(entry_json(spark, sf)).select("accession", "entry", "name", "start", "end", "ranges", "n_fragments", "go_terms_mf", "go_terms_bp", "description")


@query("s10_member_databases", f"""WITH {OCC} SELECT acc AS entry, pname AS name, 'pfam' AS member_db, 'PF' || part AS member_accession, label AS member_name FROM occ WHERE flag <> 'R'""")
def member_databases(spark, sf):
    return entries.entry_members(entry_json(spark, sf))


@query("s11_structural_hits", f"""WITH {OCC} SELECT 'P' || protein AS accession, 'G3DSA:1.10.' || (part % 9) || '.' || (supp % 9) AS struct_id, '1.10.' || (part % 9) || '.' || (supp % 9) AS cath_superfamily, '1' AS cath_class, '10' AS cath_arch, CAST(part % 9 AS VARCHAR) AS cath_topology,
  {E_RANGES} AS ranges, CAST(CASE WHEN "end" - start >= 30 THEN 2 ELSE 1 END AS INTEGER) AS n_fragments FROM occ WHERE flag = 'R'""")
def structural_hits(spark, sf):
    return entries.entries_to_structures(entry_json(spark, sf)).drop("segments")


@query("s12_merge_sources", f"""WITH {OCC}, e AS (SELECT protein, CASE WHEN flag = 'R' THEN 'G3DSA:1.10.' || (part % 9) || '.' || (supp % 9) ELSE acc END AS a, start, CASE WHEN "end" - start >= 30 THEN start + 9 ELSE "end" END AS fe, CASE WHEN status = 'F' THEN 0 ELSE 1 END AS src FROM occ)
SELECT 'P' || protein AS accession, a AS entry, min(src) AS source_rank FROM e GROUP BY protein, a, start, fe""")
def merge_sources(spark, sf):
    # Of an entry only its accession and locations are merged: names, terms and members are not sent.
    slim = F.struct(F.struct("e.metadata.accession").alias("metadata"), F.col("e.proteins").alias("proteins"))
    both = entry_json(spark, sf).select("accession", "status", F.col("key").alias("position"), slim.alias("e"))
    merged = entries.merge_entry_sources(both.filter("status = 'F'").select("accession", "position", "e"), both.filter("status <> 'F'").select("accession", "position", "e"))
    return merged.select("accession", F.col("e.metadata.accession").alias("entry"), "source_rank")


def fasta_records(spark, sf):
    docs = table(spark, sf, "documents")
    k = F.col("doc_id")
    tag = F.when(k % 4 == 0, F.lit("_HUMAN thing")).when(k % 4 == 1, F.lit(" OX=10090")).when(k % 4 == 2, F.lit(" species=Rat")).otherwise(F.lit(" nothing"))
    seq = F.regexp_replace("text", "[^A-Za-z]", "")
    return docs.select(F.concat(F.lit("sp|D"), text(k), F.lit("-2|E"), text(k), tag, F.lit("\n"), F.regexp_replace(seq, "(.{60})", "$1\n")).alias("record"))


FASTA = """f AS (SELECT 'D' || doc_id AS accession, CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'mouse' WHEN 2 THEN 'rat' ELSE CASE WHEN doc_id % 3 = 0 THEN 'yeast' END END AS species, regexp_replace(text, '[^A-Za-z]', '', 'g') AS sequence FROM documents)"""


@query("s13_read_fasta", f"WITH {FASTA} SELECT accession, species, sequence FROM f")
def read_fasta(spark, sf):
    path = scratch_path(spark, "fasta")
    fasta_records(spark, sf).select(F.concat(F.lit(">"), "record").alias("value")).write.text(path)
    known = table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("D"), text("doc_id")).alias("accession"), F.lit("yeast").alias("species"))
    return sequences.read_fasta(spark, path, known).select("accession", "species", "sequence")


@query("s14_fasta_tags", """SELECT '>D' || c_custkey || ' species=human gene=' || c_name || ' group=' || c_mktsegment || chr(10) || c_name AS value FROM customer""")
def fasta_tags(spark, sf):
    return sequences.fasta_text(table(spark, sf, "customer").select(
        F.concat(F.lit("D"), text("c_custkey")).alias("header"), F.lit("human").alias("species"), F.col("c_name").alias("gene_symbol"),
        F.col("c_mktsegment").alias("protein_group"), F.col("c_name").alias("sequence"),
    ))


@query("s15_cluster_blocks", """WITH k AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) AS cluster_id, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS rep FROM orders)
SELECT 'O' || o_orderkey AS accession, CASE WHEN o_orderkey % 2 = 0 THEN 'human' ELSE 'mouse' END AS species, 'O' || rep AS representative, cluster_id FROM k""")
def cluster_blocks(spark, sf):
    orders = table(spark, sf, "orders")
    heads = orders.select("o_custkey").distinct().select(F.col("o_custkey").alias("c"), F.lit(-1).cast("long").alias("o"), F.lit("Cluster#").alias("value"))
    body = orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.concat(
        F.lit(">sp|O"), text("o_orderkey"), F.lit("|X"), F.when(F.col("o_orderkey") % 2 == 0, "_HUMAN").otherwise("_MOUSE")).alias("value"))
    out = sequences.number_clusters(heads.unionByName(body), ["c", "o"], F.floor(F.col("c") / 64))
    return out.select("accession", "species", "representative", "cluster_id")


@query("s16_cluster_pairs", """WITH k AS (SELECT o_custkey, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders)
SELECT 'O' || o_orderkey AS accession, 'C' || o_custkey AS representative, dense_rank() OVER (ORDER BY f) AS cluster_id FROM k""")
def cluster_pairs(spark, sf):
    lines = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("C"), text("o_custkey"), F.lit("\tsp|O"), text("o_orderkey"), F.lit("|N")).alias("value"))
    return sequences.rank_clusters(lines, ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096)).drop("o_orderkey")


@query("s15_s16_read_clusters", """SELECT 'O' || o_orderkey AS accession, 'C' || o_custkey AS representative FROM orders""")
def read_clusters(spark, sf):
    path = scratch_path(spark, "clusters")
    table(spark, sf, "orders").select(F.concat(F.lit("C"), text("o_custkey"), F.lit("\tO"), text("o_orderkey")).alias("value")).write.text(path)
    return sequences.read_clusters(spark, path).select("accession", "representative")


@query("s17_background_pairs", """SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS accession, 'INTERPRO:IPR' || lpad(CAST(unnest([p_size, p_partkey % 100]) AS VARCHAR), 6, '0') AS domain_type_id FROM part""")
def background_pairs(spark, sf):
    ipr = lambda c: F.concat(F.lit("IPR"), F.lpad(text(c), 6, "0"))
    part = table(spark, sf, "part").select(text("p_partkey").alias("accession"), F.concat(ipr(F.col("p_size")), F.lit(" x;"), ipr(F.col("p_partkey") % 100), F.lit(";")).alias("cell"))
    return tables.background_pairs(part, "accession", "cell")


@query("s18_identity_distances", """WITH r AS (SELECT 'S' || l_suppkey AS q, 'S' || (l_partkey % 100) AS t, l_quantity AS p, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS pos FROM lineitem),
x AS (SELECT least(q, t) AS a, greatest(q, t) AS b, p, pos FROM r WHERE q <> t) SELECT a, b, round(1 - arg_max(p, pos) / 100, 6) AS distance FROM x GROUP BY a, b""")
def identity_distances(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("sp|S"), text("l_suppkey"), F.lit("|N")).alias("query"), F.concat(F.lit("S"), text(F.col("l_partkey") % 100), F.lit(" text")).alias("target"),
        F.col("l_quantity").alias("pident"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("pos"),
    )
    return tables.identity_distances(rows, "query", "target", "pident", ["pos"]).withColumn("distance", F.round("distance", 6))


@query("s19_filter_regions", f"""WITH {OCC}, n AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY key) AS rn FROM occ WHERE flag <> 'R')
SELECT protein, coalesce(string_agg(rn || ') ' || start || '-' || "end" || ' | len=' || ("end" - start + 1) || CASE WHEN status = 'F' THEN ' | name=' || acc ELSE '' END || ' | desc=' || pname, ' ; ' ORDER BY rn), '') AS regions_filtered_pretty,
  CAST(count(rn) AS INTEGER) AS region_remained_count FROM (SELECT DISTINCT protein FROM occ) LEFT JOIN n USING (protein) GROUP BY protein""")
def filter_regions(spark, sf):
    occ = occurrences(spark, sf)
    item = F.concat(
        text("start"), F.lit("-"), text("end"), F.lit(" | len="), text(F.col("end") - F.col("start") + 1), F.when(F.col("status") == "F", F.concat(F.lit(" | name="), "acc")).otherwise(""),
        F.lit(" | desc="), F.when(F.col("flag") == "R", "Disordered").otherwise(F.col("pname")),
    )
    listed = occ.groupBy("protein").agg(F.array_sort(F.collect_list(F.struct("key", item.alias("t")))).alias("x"))
    pretty = F.array_join(F.transform("x", lambda e, i: F.concat((i + 1).cast("string"), F.lit(") "), e["t"])), " ; ")
    return regions.filter_regions(listed.select("protein", pretty.alias("regions_pretty"))).drop("regions_pretty")


@query("s22_batch_status", """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'ERROR' WHEN n IS NULL THEN 'MISSING' ELSE 'OK' END AS status, coalesce(n, 0) AS n_rows, CASE WHEN c_custkey % 13 = 0 THEN 'failed' ELSE '' END AS note
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def batch_status(spark, sf):
    landed = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf, "customer")
    errors = customer.filter("c_custkey % 13 = 0").select("c_custkey", F.lit("failed").alias("note"))
    return tables.batch_status(customer, landed, "c_custkey", errors)


@query("t01_incremental_landing", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def incremental_landing(spark, sf):
    root = scratch_path(spark, "landing")
    key, tie = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]
    line = table(spark, sf, "lineitem").select(*key, *tie)
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint"
    for flag in (0, 1):
        line.filter(F.col("l_suppkey") % 2 == flag).write.mode("append").parquet(f"{root}/in")
        landing.land(spark, f"{root}/in", schema, f"{root}/out", f"{root}/progress", key, tie)
    return landing.current(spark, f"{root}/out", key, tie)


@query("t01_unprocessed_keys", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')""")
def unprocessed(spark, sf):
    landed = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise(" ").alias("content"))
    return landing.unprocessed(table(spark, sf, "customer"), landed, "c_custkey", "content")
