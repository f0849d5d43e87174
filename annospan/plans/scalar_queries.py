"""The projection library: every function as a column over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.functions import cells, formats, spans, stats, text_similarity, tiers
from annospan.plans.base import OCC, occurrences, query, segmented, table, text


@query("f01_f03_f24_split_cell", """
WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key,
       ' ' || l_returnflag || ' ; ' || p_name || ';;' || p_brand || ' ;' || l_returnflag AS cell, p_name || '||' || p_brand || '|' || p_type || '//' || l_linestatus AS alt
  FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT key, list_filter(list_transform(string_split(cell, ';'), lambda x: trim(x)), lambda x: x <> '') AS t,
       list_filter(list_transform(regexp_split_to_array(alt, '\\|\\||\\||//|;'), lambda x: trim(x)), lambda x: x <> '') AS a FROM c)
SELECT key, array_to_string(t, '+') AS tokens, CAST(len(t) AS INTEGER) AS n_tokens,
       array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ';') AS joined,
       array_to_string(a, '+') AS alternatives FROM t""")
def split_cell(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    cell = F.concat(F.lit(" "), "l_returnflag", F.lit(" ; "), "p_name", F.lit(";;"), "p_brand", F.lit(" ;"), "l_returnflag")
    alt = F.concat("p_name", F.lit("||"), "p_brand", F.lit("|"), "p_type", F.lit("//"), "l_linestatus")
    delimiter = cells.cell_delimiter("cell", {"other": ","})
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("key"),
        cells.split_cell(cell, delimiter).alias("t"), cells.split_alternatives(alt).alias("a"),
    ).select("key", F.array_join("t", "+").alias("tokens"), F.size("t").alias("n_tokens"), cells.join_tokens("t").alias("joined"), F.array_join("a", "+").alias("alternatives"))


@query("f02_f04_split_multi_norm_space", """
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name || ',' || p_brand || ' | ' || p_type, '[;,|\\s]+'), lambda x: x <> ''), '+') AS tokens,
       trim(regexp_replace('  ' || p_name || '   ' || p_type || ' ', '\\s+', ' ', 'g')) AS spaced FROM part""")
def split_multi(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(cells.split_multi(F.concat("p_name", F.lit(","), "p_brand", F.lit(" | "), "p_type")), "+").alias("tokens"),
        cells.norm_space(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("spaced"),
    )


@query("f05_safe_casts", """
WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || value || ' ' WHEN 1 THEN 'x' || value WHEN 2 THEN '' WHEN 3 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS raw,
   CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN ' f ' ELSE 'maybe' END AS flag FROM events)
SELECT event_id, CAST(trunc(TRY_CAST(trim(raw) AS DOUBLE)) AS INTEGER) AS as_int, TRY_CAST(trim(raw) AS DOUBLE) AS as_float,
  CASE lower(trim(flag)) WHEN 'yes' THEN TRUE WHEN '0' THEN FALSE WHEN 'f' THEN FALSE END AS as_bool FROM r""")
def safe_casts(spark, sf):
    k = F.col("event_id")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit(" "), text("value"), F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("x"), text("value")))
        .when(k % 5 == 2, "").when(k % 5 == 3, text("event_id")).otherwise(F.col("event_type"))
    )
    flag = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "0").when(k % 4 == 2, " f ").otherwise("maybe")
    return table(spark, sf, "events").select(
        "event_id", cells.safe_int(raw).alias("as_int"), cells.safe_float(raw).alias("as_float"), cells.safe_bool(flag).alias("as_bool")
    )


@query("f06_f07_f08_id_and_label", """
WITH r AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN 'DOP:' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || ' ' || o_orderpriority
   WHEN 1 THEN 'DOF:000001' WHEN 2 THEN o_orderpriority || ':' || (o_orderkey % 37) ELSE 'GO:0000001  ' || o_orderstatus END AS tok FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(tok, '^(DOP|DOF|GO):\\S+\\s+.+$') THEN regexp_extract(tok, '^(\\S+)\\s+(.+)$', 1) ELSE tok END AS id_part,
  CASE WHEN regexp_matches(tok, '^(DOP|DOF|GO):\\S+\\s+.+$') THEN regexp_extract(tok, '^(\\S+)\\s+(.+)$', 2) END AS label_part,
  nullif(regexp_extract(tok, '^(DO[A-Z]):', 1), '') AS namespace, regexp_replace(tok, ':\\d+$', '') AS stripped,
  CASE WHEN o_orderkey % 4 = 0 THEN 'DOP' WHEN o_orderkey % 4 = 1 THEN 'DOF' WHEN o_orderkey % 4 = 3 THEN 'GO' ELSE o_orderpriority END AS prefix FROM r""")
def id_and_label(spark, sf):
    k = F.col("o_orderkey")
    tok = (
        F.when(k % 4 == 0, F.concat(F.lit("DOP:"), F.lpad(text(k % 1000000), 6, "0"), F.lit(" "), "o_orderpriority"))
        .when(k % 4 == 1, "DOF:000001").when(k % 4 == 2, F.concat("o_orderpriority", F.lit(":"), text(k % 37)))
        .otherwise(F.concat(F.lit("GO:0000001  "), "o_orderstatus"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", cells.id_part(tok).alias("id_part"), cells.label_part(tok).alias("label_part"),
        cells.namespace_of(tok).alias("namespace"), cells.strip_count_suffix(tok).alias("stripped"), cells.id_prefix(tok).alias("prefix"),
    )


@query("f09_f10_f16_f18_identifiers", """
WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' pfam' WHEN 1 THEN 'Gene3D' WHEN 2 THEN 'prosite profiles' WHEN 3 THEN 'mobidb' WHEN 4 THEN 'unknownDB ' ELSE '' END AS db,
  CASE WHEN p_partkey % 12 = 5 THEN '' ELSE p_brand END AS acc, p_size FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'PFAM' WHEN 1 THEN 'CATH-Gene3D' WHEN 2 THEN 'PROSITE' WHEN 3 THEN 'MobiDB-lite' WHEN 4 THEN 'UNKNOWNDB' ELSE '' END AS db_name,
  nullif((CASE p_partkey % 6 WHEN 0 THEN 'PFAM' WHEN 1 THEN 'CATH-Gene3D' WHEN 2 THEN 'PROSITE' WHEN 3 THEN 'MobiDB-lite' WHEN 4 THEN 'UNKNOWNDB' ELSE '' END) || ':' || acc, ':') AS type_id,
  upper(db) || ':' || acc || '@' || p_size || '-' || (p_size + 9) AS instance_id,
  p_partkey || '|' || acc || '|' || p_size || '..' || (p_size + 9) || '|1' AS occurrence_id,
  'INTERPRO:IPR' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS interpro,
  'IPR' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS bare FROM r""")
def identifiers(spark, sf):
    k = F.col("p_partkey")
    db = (
        F.when(k % 6 == 0, " pfam").when(k % 6 == 1, "Gene3D").when(k % 6 == 2, "prosite profiles").when(k % 6 == 3, "mobidb")
        .when(k % 6 == 4, "unknownDB ").otherwise("")
    )
    acc = F.when(k % 12 == 5, "").otherwise(F.col("p_brand"))
    ipr = F.concat(F.lit("IPR"), F.lpad(text(k % 1000000), 6, "0"))
    return table(spark, sf, "part").select(
        "p_partkey", cells.normalize_db(db).alias("db_name"), cells.domain_type_id(db, acc).alias("type_id"),
        cells.instance_id(db, acc, F.col("p_size"), F.col("p_size") + 9).alias("instance_id"),
        cells.occurrence_id(k, acc, F.col("p_size"), F.col("p_size") + 9, F.lit(1)).alias("occurrence_id"),
        cells.normalize_interpro(ipr).alias("interpro"), cells.strip_db_prefix(cells.normalize_interpro(ipr)).alias("bare"),
    )


@query("f11_f12_positional_category", f"""WITH {OCC}
SELECT key, CASE WHEN line = 7 THEN 'unknown' WHEN start / 200.0 < 0.2 THEN 'Nterminal' WHEN "end" / 200.0 > 0.8 THEN 'Cterminal' ELSE 'Internal' END AS category,
  CASE WHEN line = 7 THEN NULL ELSE round_even(start / 200.0, 4) END AS relative_start,
  CASE WHEN line = 7 THEN NULL ELSE round_even("end" / 200.0, 4) END AS relative_end,
  CASE WHEN line = 7 THEN NULL ELSE round_even((start + "end") / 2.0 / 200.0, 4) END AS relative_midpoint,
  CASE flag WHEN 'R' THEN 'Internal' WHEN 'N' THEN 'Nterminal' ELSE 'Cterminal' END AS normalised
FROM occ""")
def positional(spark, sf):
    length = F.when(F.col("line") == 7, 0).otherwise(200)
    raw = F.when(F.col("flag") == "R", " Central").when(F.col("flag") == "N", "n-term").otherwise("Cter")
    return occurrences(spark, sf).select(
        "key", spans.positional_category(F.col("start"), F.col("end"), length).alias("category"),
        spans.relative(F.col("start"), length).alias("relative_start"), spans.relative(F.col("end"), length).alias("relative_end"),
        spans.relative((F.col("start") + F.col("end")) / 2, length).alias("relative_midpoint"),
        spans.normalize_positional_category(raw).alias("normalised"),
    )


@query("f13_f14_f15_interval_distances", f"""WITH {OCC},
d AS (SELECT key, start, "end", part % 150 AS fs, part % 150 + 12 AS fe, ("end" - start + 1) // 3 AS third, status = 'F' AND "end" - start >= 30 AS cut FROM occ)
SELECT key, greatest(least("end", fe) - greatest(start, fs) + 1, 0) AS overlap, greatest(fs - "end", start - fe, 0) AS distance,
  CASE WHEN cut THEN least(greatest(fs - (start + third - 1), start - fe, 0), greatest(fs - "end", "end" - third + 1 - fe, 0))
       ELSE greatest(fs - "end", start - fe, 0) END AS segment_distance,
  CASE WHEN cut THEN start || '..' || (start + third - 1) || ';' || ("end" - third + 1) || '..' || "end" ELSE start || '..' || "end" END AS ranges
FROM d""")
def distances(spark, sf):
    seg = segmented(occurrences(spark, sf)).withColumn("ranges", spans.ranges_text(F.col("segments")))
    fs = F.col("part") % 150
    parsed = spans.parse_ranges(F.concat("ranges", F.lit(";9..3;junk")))
    return seg.select(
        "key", spans.overlap_len(F.col("start"), F.col("end"), fs, fs + 12).alias("overlap"),
        spans.interval_distance(F.col("start"), F.col("end"), fs, fs + 12).alias("distance"),
        spans.segments_distance(parsed, fs, fs + 12).alias("segment_distance"), spans.ranges_text(parsed).alias("ranges"),
    )


@query("f17_slice_sequence", """
WITH r AS (SELECT doc_id, text, length(text) AS n, doc_id % 90 + 1 AS s, doc_id % 90 + 60 AS e FROM documents)
SELECT doc_id, CASE WHEN e <= n THEN substr(text, s, 60 - 1 + 1) ELSE '' END AS domain_sequence,
  substr(text, s, 1) AS start_residue, CASE WHEN e <= n THEN substr(text, e, 1) ELSE '' END AS end_residue FROM r WHERE s <= n
UNION ALL SELECT doc_id, '', '', '' FROM r WHERE s > n""")
def slices(spark, sf):
    s, e = (F.col("doc_id") % 90 + 1).cast("int"), (F.col("doc_id") % 90 + 60).cast("int")
    return table(spark, sf, "documents").select(
        "doc_id", spans.slice_sequence(F.col("text"), s, e).alias("domain_sequence"),
        spans.residue(F.col("text"), s).alias("start_residue"), spans.residue(F.col("text"), e).alias("end_residue"),
    )


@query("f19_f20_f21_chebi_and_iris", """
WITH r AS (SELECT c_custkey, 'CHEBI:CHEBI:' || c_custkey || ' x chebi:' || (c_custkey % 7) || ';CHEBI:' || c_custkey AS t, (c_nationkey % 10) || ' ' || c_name || '/(' || c_mktsegment || ')' AS raw, c_custkey % 3 AS k, c_mktsegment FROM customer)
SELECT c_custkey, replace(t, 'CHEBI:CHEBI:', 'CHEBI:') AS fixed, CAST(1 AS INTEGER) AS n_fixed,
  array_to_string(list_distinct_ordered, ';') AS chebi,
  'id_' || regexp_replace(regexp_replace(raw, '\\s+', '_', 'g'), '[^A-Za-z0-9_.\\-]', '_', 'g') AS fragment,
  'http://purl.obolibrary.org/obo/CHEBI_' || c_custkey AS iri,
  c_mktsegment AS label
FROM (SELECT *, CASE WHEN c_custkey = c_custkey % 7 THEN ['CHEBI:' || c_custkey] ELSE ['CHEBI:' || c_custkey, 'CHEBI:' || (c_custkey % 7)] END AS list_distinct_ordered FROM r)""")
def chebi_and_iris(spark, sf):
    k = F.col("c_custkey")
    t = F.concat(F.lit("CHEBI:CHEBI:"), text(k), F.lit(" x chebi:"), text(k % 7), F.lit(";CHEBI:"), text(k))
    raw = F.concat(text(F.col("c_nationkey") % 10), F.lit(" "), "c_name", F.lit("/("), "c_mktsegment", F.lit(")"))
    return table(spark, sf, "customer").select(
        "c_custkey", cells.fix_chebi_prefix(t).alias("fixed"), cells.chebi_fix_count(t).alias("n_fixed"),
        F.array_join(cells.extract_chebi(t), ";").alias("chebi"), cells.iri_fragment(raw).alias("fragment"),
        cells.obo_iri(F.concat(F.lit("CHEBI:"), text(k))).alias("iri"),
        cells.display_label(F.concat(F.lit("DOF:000001 "), "c_mktsegment")).alias("label"),
    )


@query("f22_f23_first_and_extract", """
SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '  ' WHEN page_id % 3 = 1 THEN 'nan' ELSE 'name' || page_id END), ''), '') = '' AS blank,
  CASE WHEN page_id % 3 = 2 THEN 'name' || page_id ELSE url END AS first_value,
  array_to_string(list_filter(regexp_extract_all(html, 'id_?[0-9]+'), lambda x, i: list_position(regexp_extract_all(html, 'id_?[0-9]+'), x) = i), ';') AS ids,
  array_to_string(list_filter(regexp_extract_all(url, '[a-z]+\\.'), lambda x, i: list_position(regexp_extract_all(url, '[a-z]+\\.'), x) = i), ';') AS url_parts FROM pages""")
def first_and_extract(spark, sf):
    k = F.col("page_id")
    raw = F.when(k % 3 == 0, "  ").when(k % 3 == 1, "nan").otherwise(F.concat(F.lit("name"), text(k)))
    return table(spark, sf, "pages").select(
        "page_id", (F.trim(raw) == "").alias("blank"), cells.first_non_empty(raw, "url").alias("first_value"),
        cells.join_tokens(cells.extract_ids("html", "id_?[0-9]+")).alias("ids"),
        cells.join_tokens(cells.extract_ids("url", r"[a-z]+\.", skip_unknown=True)).alias("url_parts"),
    )


@query("f25_f35_ordinals_accessions", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN rn = 1 THEN 'N' WHEN rn = n THEN 'C' ELSE 'N+' || (rn - 1) END AS label,
  CAST(rn AS INTEGER) AS back, 'Q' || lpad(CAST(conv_id % 100000 AS VARCHAR), 5, '0') AS accession FROM r""")
def ordinals(spark, sf):
    from annospan.operators.ordered import ordered_scan, row_number

    conv = table(spark, sf, "conversations")
    ranked = ordered_scan(conv.select("conv_id", "turn"), ["conv_id"], F.floor(F.col("turn") / 64), ["turn"], rn=row_number())
    sized = ranked.join(conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id")
    label = cells.ordinal_label(F.col("rn"), F.col("n"))
    header = F.concat(F.lit(">sp|Q"), F.lpad(text(F.col("conv_id") % 100000), 5, "0"), F.lit("-2|ENTRY_HUMAN text"))
    return sized.select("conv_id", "turn", label.alias("label"), cells.ordinal_index(label, F.col("n")).alias("back"), cells.extract_accession(header).alias("accession"))


@query("f26_symbol_similarity")
def symbol_similarity(spark, sf):
    part = table(spark, sf, "part")
    names = part.groupBy("p_brand").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return names.select(
        "p_brand", text_similarity.symbol_similarity(F.col("a"), F.col("b")).alias("name_similarity"),
        text_similarity.symbol_similarity(F.col("p_brand"), F.lit("BRAND#1")).alias("brand_similarity"),
    )


@query("f27_f29_f30_ratios_and_tiers", """
SELECT o_orderkey, CASE WHEN c_acctbal > 0 AND o_totalprice > 0 THEN round(least(c_acctbal, o_totalprice) / greatest(c_acctbal, o_totalprice), 6) ELSE 0.0 END AS length_ratio,
  CASE WHEN o_orderkey % 11 = 0 OR (o_orderkey % 101) / 100.0 >= 0.999 THEN 'easy' WHEN (o_orderkey % 101) / 100.0 >= 0.7 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN o_orderstatus = 'F' AND (o_orderkey % 5 = 0 OR c_mktsegment = 'BUILDING') THEN 'high_confidence'
       WHEN o_orderstatus = 'F' OR o_orderkey % 5 = 0 THEN 'probable'
       WHEN c_mktsegment = 'BUILDING' AND (o_orderkey % 101) / 100.0 >= 0.7 THEN 'possible' ELSE 'low_confidence' END AS confidence
FROM orders JOIN customer ON o_custkey = c_custkey""")
def ratios_and_tiers(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sim, k = (F.col("o_orderkey") % 101) / 100, F.col("o_orderkey")
    return joined.select(
        "o_orderkey", F.round(spans.length_ratio(F.col("c_acctbal"), F.col("o_totalprice")), 6).alias("length_ratio"),
        tiers.difficulty_tier(sim, k % 11 == 0).alias("difficulty"),
        tiers.confidence_tier(F.col("o_orderstatus") == "F", k % 5 == 0, F.col("c_mktsegment") == "BUILDING", sim).alias("confidence"),
    )


@query("f28_format_checks", """
SELECT p_partkey, regexp_full_match(go, 'GO:\\d{7}') AS go_ok, regexp_full_match(kegg, '[a-z]{2,5}:\\d+') AS kegg_ok,
  regexp_full_match(acc, '[A-Z][0-9][A-Z0-9]{3}[0-9]([A-Z][0-9][A-Z0-9]{3}[0-9])?') AS acc_ok,
  regexp_full_match(ipr, 'INTERPRO:IPR\\d{6}') AS type_ok, regexp_full_match(react, 'R-[A-Z]{3}-\\d+') AS reactome_ok
FROM (SELECT p_partkey, 'GO:' || lpad(CAST(p_partkey * 977 AS VARCHAR), CAST(5 + p_partkey % 4 AS INTEGER), '0') AS go,
  CASE p_partkey % 3 WHEN 0 THEN 'hsa:' || p_partkey WHEN 1 THEN 'HSA:1' ELSE 'toolong:1' END AS kegg,
  CASE p_partkey % 2 WHEN 0 THEN 'P' || (p_partkey % 10) || 'ABC' || (p_size % 10) ELSE p_brand END AS acc,
  'INTERPRO:IPR' || p_partkey AS ipr, 'R-HS' || (CASE WHEN p_size > 25 THEN 'A' ELSE 'a' END) || '-' || p_size AS react FROM part)""")
def format_checks(spark, sf):
    k = F.col("p_partkey")
    go = F.concat(F.lit("GO:"), F.expr("lpad(cast(p_partkey * 977 as string), cast(5 + p_partkey % 4 as int), '0')"))
    kegg = F.when(k % 3 == 0, F.concat(F.lit("hsa:"), text(k))).when(k % 3 == 1, "HSA:1").otherwise("toolong:1")
    acc = F.when(k % 2 == 0, F.concat(F.lit("P"), text(k % 10), F.lit("ABC"), text(F.col("p_size") % 10))).otherwise(F.col("p_brand"))
    react = F.concat(F.lit("R-HS"), F.when(F.col("p_size") > 25, "A").otherwise("a"), F.lit("-"), text("p_size"))
    ok = formats.format_ok
    return table(spark, sf, "part").select(
        "p_partkey", ok(go, "go").alias("go_ok"), ok(kegg, "kegg").alias("kegg_ok"), ok(acc, "accession").alias("acc_ok"),
        ok(F.concat(F.lit("INTERPRO:IPR"), text(k)), "domain_type").alias("type_ok"), ok(react, "reactome").alias("reactome_ok"),
    )


@query("f31_f32_modules_and_relations", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'kinase' WHEN 1 THEN 'receptor' WHEN 2 THEN 'lipid' ELSE 'other' END AS module,
  CASE event_type WHEN 'click' THEN 'function_tag' WHEN 'view' THEN 'binding_target' WHEN 'error' THEN 'topology_context' ELSE event_type END AS relation,
  event_type AS value FROM events""")
def modules_and_relations(spark, sf):
    k, t = F.col("event_id"), F.col("event_type")
    family = F.when(k % 4 == 0, "MAPK").when(k % 4 == 1, "GPCR_class_B").when(k % 4 == 2, "phospholipase_D").otherwise(t)
    rel = F.when(t == "click", "hasFunctionTag").when(t == "view", "binding_parnter").when(t == "error", "topology").otherwise(t)
    return table(spark, sf, "events").select(
        "event_id", cells.module_of(family).alias("module"), cells.relation_alias(rel).alias("relation"),
        cells.norm_value(F.concat(F.lit("DOT:000079 "), t)).alias("value"),
    )


@query("f33_pretty_texts", f"""WITH {OCC},
n AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY start, "end", part, supp) AS rn FROM occ)
SELECT protein,
  string_agg(rn || ') ' || start || '-' || "end" || ' | ' || label || ' [BRAND:' || acc || '] | pos=' || status || ' | sigs=' || acc || ', ' || flag, ' ; ' ORDER BY rn) AS instances,
  string_agg(rn || ') ' || pname || ' (' || acc || ') | ranges=' || start || '..' || "end", ' ; ' ORDER BY rn) AS domains,
  string_agg(CASE WHEN flag = 'N' THEN acc ELSE 'SRC' || flag || ':' || acc END || CASE WHEN status = 'F' THEN ' (' || pname || ')' ELSE '' END || ' | ranges=' || start, ' ; ' ORDER BY rn) AS signatures
FROM n GROUP BY protein""")
def pretty(spark, sf):
    occ = occurrences(spark, sf)
    key = [F.col("start").alias("start"), F.col("end").alias("end"), F.col("part").alias("part"), F.col("supp").alias("supp")]
    rows = F.array_sort(F.collect_list(F.struct(
        *key, F.col("label").alias("label"), F.lit("BRAND").alias("db"), F.col("acc").alias("acc"), F.col("status").alias("pos"),
        F.array("acc", "flag").alias("signatures"), F.col("pname").alias("pname"), F.col("flag").alias("flag"),
    )))
    lists = occ.groupBy("protein").agg(rows.alias("r"))
    domains = F.transform("r", lambda x: F.struct(
        x["pname"].alias("name"), x["acc"].alias("acc"), F.concat_ws("..", text(x["start"]), text(x["end"])).alias("ranges")
    ))
    sigs = F.transform("r", lambda x: F.struct(
        F.when(x["flag"] == "N", "").otherwise(F.concat(F.lit("src"), x["flag"])).alias("db"), x["acc"].alias("acc"),
        F.when(x["pos"] == "F", x["pname"]).otherwise("").alias("name"), text(x["start"]).alias("ranges"),
    ))
    return lists.select(
        "protein", spans.pretty_instances(F.col("r")).alias("instances"), spans.pretty_domains(domains).alias("domains"),
        spans.pretty_signatures(sigs).alias("signatures"),
    )


@query("f34_interpretation_bands", """
SELECT vec_id, CASE WHEN x >= 0.8 THEN 'near-perfect agreement' WHEN x >= 0.6 THEN 'strong agreement' WHEN x >= 0.4 THEN 'moderate agreement'
  WHEN x >= 0.2 THEN 'weak agreement' WHEN x >= 0 THEN 'near-random agreement' ELSE 'worse than random (possible systematic disagreement)' END AS agreement,
  CASE WHEN x > 0.7 THEN 'strong positive' WHEN x > 0.4 THEN 'moderate positive' WHEN x > 0.1 THEN 'weak positive' WHEN x > -0.1 THEN 'negligible' ELSE 'negative' END
  || '; ' || CASE WHEN p < 0.001 THEN 'highly significant (p < 0.001)' WHEN p < 0.01 THEN 'significant (p < 0.01)' WHEN p < 0.05 THEN 'significant (p < 0.05)' ELSE 'not significant (p >= 0.05)' END AS correlation
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 3 AS x, (vec_id % 1000) / 10000.0 AS p FROM embeddings)""")
def bands(spark, sf):
    from annospan.operators.similarity import mantel_interpretation

    x, p = F.col("embedding")[0].cast("double") * 3, (F.col("vec_id") % 1000) / 10000
    return table(spark, sf, "embeddings").select("vec_id", tiers.ari_band(x).alias("agreement"), mantel_interpretation(x, p).alias("correlation"))


@query("f_stats_log_gamma_erfc", """
SELECT p_partkey, round(lgamma(p_size + p_partkey), 5) AS ln_gamma FROM part""")
def log_gamma(spark, sf):
    n = F.col("p_size") + F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.round(stats.ln_gamma(n), 5).alias("ln_gamma"))
