"""Order, overlap groups, neighbours, range joins and nearest features."""

from __future__ import annotations

from pyspark.sql import functions as F

from annospan.functions.spans import ranges_text
from annospan.operators import intervals as iv
from annospan.plans.base import FEAT, OCC, SEG, features, occurrences, query, segmented, text

TIE = ["part", "supp"]
ORDER = 'start, "end", acc, part, supp'

GROUPS = f"""{OCC},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY protein ORDER BY {ORDER}) AS ordinal_position_all,
         max("end") OVER (PARTITION BY protein ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM occ),
grouped AS (
  SELECT *, CAST(sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END)
         OVER (PARTITION BY protein ORDER BY {ORDER}) AS BIGINT) AS overlap_group_id
  FROM ranked)"""

REPS = f"""{GROUPS},
numbered AS (
  SELECT *, count(*) OVER (PARTITION BY protein, overlap_group_id) AS overlap_group_size,
         row_number() OVER (PARTITION BY protein, overlap_group_id
                            ORDER BY -("end" - start + 1), start, acc, part, supp) AS rk
  FROM grouped),
reps AS (
  SELECT protein, overlap_group_id, overlap_group_size, start AS rep_start, "end" AS rep_end, acc AS rep_acc, key AS rep_key,
         lag(acc) OVER w AS prev_domain_type, lead(acc) OVER w AS next_domain_type,
         start - lag("end") OVER w AS gap_from_prev, lead(start) OVER w - "end" AS gap_to_next
  FROM numbered WHERE rk = 1 WINDOW w AS (PARTITION BY protein ORDER BY start, "end", acc))"""


@query("w01_w02_overlap_groups", f"""WITH {GROUPS}
SELECT key, ordinal_position_all, overlap_group_id FROM grouped""")
def overlap_groups(spark, sf):
    return iv.overlap_groups(occurrences(spark, sf), tie=["acc", *TIE]).select("key", "ordinal_position_all", "overlap_group_id")


@query("w03_w04_domain_order", f"""WITH {REPS}
SELECT g.key, r.overlap_group_size, r.rep_acc AS representative_type, g.overlap_group_id AS ordinal_position_group,
       g.key = r.rep_key AS is_representative,
       CASE WHEN g.key = r.rep_key THEN 'self'
            WHEN r.rep_start <= g.start AND g."end" <= r.rep_end THEN 'contained_in_rep'
            WHEN g.start <= r.rep_start AND r.rep_end <= g."end" THEN 'contains_rep'
            ELSE 'overlaps_rep' END AS overlap_relation_to_rep,
       r.prev_domain_type, r.next_domain_type,
       CASE WHEN g.key = r.rep_key THEN r.gap_from_prev END AS gap_from_prev,
       CASE WHEN g.key = r.rep_key THEN r.gap_to_next END AS gap_to_next,
       CASE WHEN g.key = r.rep_key THEN r.gap_from_prev <= 1 END AS adjacent_to_prev,
       CASE WHEN g.key = r.rep_key THEN r.gap_to_next <= 1 END AS adjacent_to_next
FROM grouped g JOIN reps r USING (protein, overlap_group_id)""")
def domain_order(spark, sf):
    # Only what the order and the result need travels through its scans.
    needed = occurrences(spark, sf).select("protein", "acc", "start", "end", *TIE, "key")
    return iv.domain_order(needed, tie=TIE).select(
        "key", "overlap_group_size", "representative_type", "ordinal_position_group", "is_representative",
        "overlap_relation_to_rep", "prev_domain_type", "next_domain_type", "gap_from_prev", "gap_to_next",
        "adjacent_to_prev", "adjacent_to_next",
    )


@query("w05_order_edges_representatives", f"""WITH {REPS}
SELECT protein, rep_key AS occurrence_id,
       lag(rep_key) OVER w AS prev_occurrence_id, lead(rep_key) OVER w AS next_occurrence_id,
       gap_from_prev, gap_to_next,
       CASE row_number() OVER w WHEN 1 THEN 'N' WHEN count(*) OVER (PARTITION BY protein) THEN 'C'
            ELSE 'N+' || (row_number() OVER w - 1) END AS ordinal_label_nc,
       'representatives' AS edge_scope
FROM reps WINDOW w AS (PARTITION BY protein ORDER BY rep_start, rep_end, rep_acc, rep_key)""")
def order_edges(spark, sf):
    return iv.order_edges(occurrences(spark, sf), "key", tie=TIE).drop("adjacent_to_prev", "adjacent_to_next")


@query("w05_order_edges_all", f"""WITH {OCC}
SELECT protein, key AS occurrence_id,
       lag(key) OVER w AS prev_occurrence_id, lead(key) OVER w AS next_occurrence_id,
       start - lag("end") OVER w AS gap_from_prev, lead(start) OVER w - "end" AS gap_to_next,
       start - lag("end") OVER w <= 1 AS adjacent_to_prev, lead(start) OVER w - "end" <= 1 AS adjacent_to_next,
       CASE row_number() OVER w WHEN 1 THEN 'N' WHEN count(*) OVER (PARTITION BY protein) THEN 'C'
            ELSE 'N+' || (row_number() OVER w - 1) END AS ordinal_label_nc,
       'all_occurrences' AS edge_scope
FROM occ WINDOW w AS (PARTITION BY protein ORDER BY start, "end", acc, key)""")
def order_edges_all(spark, sf):
    return iv.order_edges_all(occurrences(spark, sf), "key")


@query("w05_labels_of_members", f"""WITH {REPS},
labelled AS (
  SELECT protein, overlap_group_id,
         CASE row_number() OVER w WHEN 1 THEN 'N' WHEN count(*) OVER (PARTITION BY protein) THEN 'C'
              ELSE 'N+' || (row_number() OVER w - 1) END AS ordinal_label_nc
  FROM reps WINDOW w AS (PARTITION BY protein ORDER BY rep_start, rep_end, rep_acc, rep_key))
SELECT key AS occurrence_id, ordinal_label_nc FROM grouped JOIN labelled USING (protein, overlap_group_id)""")
def label_members(spark, sf):
    return iv.domain_order(occurrences(spark, sf), tie=TIE).select(F.col("key").alias("occurrence_id"), "ordinal_label_nc")


@query("w06_copy_number", f"""WITH {OCC}
SELECT key, count(*) OVER (PARTITION BY protein, acc) AS copy_number FROM occ""")
def copy_number(spark, sf):
    return iv.copy_number(occurrences(spark, sf)).select("key", "copy_number")


@query("w07_canonical_instances", f"""WITH {OCC}, {SEG}
SELECT key, min(s1) AS start, max(e1) AS "end", string_agg(s1 || '..' || e1, ';' ORDER BY s1, e1) AS ranges,
       CASE WHEN count(*) > 1 THEN 'DiscontinuousDomain' ELSE 'ContinuousDomain' END AS continuity_category
FROM seg GROUP BY key""")
def canonical_instances(spark, sf):
    raw = segmented(occurrences(spark, sf)).drop("start", "end")
    out = iv.canonical_instances(raw)
    return out.select("key", "start", "end", ranges_text(F.col("segments")).alias("ranges"), "continuity_category")


@query("j03_topology_and_sites", f"""WITH {OCC}, {FEAT},
marked AS (
  SELECT *, CASE WHEN ftype = 'TRANSMEM' THEN 'transmembrane' WHEN ftype = 'SIGNAL' THEN 'signal_peptide'
                 WHEN ftype = 'TOPO_DOM' AND lower(note) LIKE '%cytoplasm%' THEN 'cytoplasmic'
                 WHEN ftype = 'TOPO_DOM' AND lower(note) LIKE '%extracellular%' THEN 'extracellular'
                 WHEN ftype = 'TOPO_DOM' AND lower(note) LIKE '%lumen%' THEN 'luminal' END AS ctx,
         CASE WHEN ftype = 'BINDING' THEN ftype || ':' || fstart || '..' || fend || ':' || note END AS site
  FROM feat),
hits AS (SELECT o.key, ctx, site FROM occ o JOIN marked f ON o.protein = f.protein AND o.start <= f.fend AND f.fstart <= o."end"),
agg AS (SELECT key, string_agg(DISTINCT ctx, ';' ORDER BY ctx) AS c, string_agg(DISTINCT site, ';' ORDER BY site) AS b FROM hits GROUP BY key)
SELECT o.key, coalesce(c, 'unknown') AS topology_context, coalesce(b, '') AS binding_site_types,
       CASE WHEN c IS NULL THEN 'NoTopologyFeatures' ELSE 'FromUniProtFT' END AS topology_evidence,
       CASE WHEN b IS NULL THEN 'NoBindingSites' ELSE 'FromUniProtFT' END AS binding_site_evidence
FROM occ o LEFT JOIN agg USING (key)""")
def topology(spark, sf):
    return iv.topology_context(occurrences(spark, sf), features(spark, sf), "key").select(
        "key", "topology_context", "binding_site_types", "topology_evidence", "binding_site_evidence"
    )


@query("j04_disorder_status", f"""WITH {OCC}, {FEAT},
dis AS (SELECT * FROM feat WHERE ftype = 'COMPBIAS'),
cov AS (SELECT o.key, sum(least(o."end", f.fend) - greatest(o.start, f.fstart) + 1) AS ov
        FROM occ o JOIN dis f ON o.protein = f.protein AND o.start <= f.fend AND f.fstart <= o."end" GROUP BY o.key),
known AS (SELECT DISTINCT protein FROM dis)
SELECT o.key, CASE WHEN k.protein IS NULL THEN 'unknown'
                   WHEN coalesce(ov, 0) / (o."end" - o.start + 1) >= 0.7 THEN 'disordered'
                   WHEN coalesce(ov, 0) / (o."end" - o.start + 1) <= 0.3 THEN 'structured' ELSE 'mixed' END AS disorder_status,
       CASE WHEN k.protein IS NULL THEN 'NoDisorderFeatures' ELSE 'FromUniProtFT' END AS disorder_evidence
FROM occ o LEFT JOIN cov USING (key) LEFT JOIN known k ON k.protein = o.protein""")
def disorder(spark, sf):
    feat = features(spark, sf).filter(F.col("ftype").isin(iv.DISORDER_TYPES))
    return iv.disorder_status(occurrences(spark, sf), feat, "key").select("key", "disorder_status", "disorder_evidence")


@query("j05_j06_proximity", f"""WITH {OCC}, {FEAT},
dist AS (SELECT o.key, f.ftype, greatest(f.fstart - o."end", o.start - f.fend, 0) AS d
         FROM occ o JOIN feat f ON o.protein = f.protein),
near AS (SELECT key, min(CASE WHEN ftype = 'TRANSMEM' THEN d END) AS tm,
                min(CASE WHEN ftype IN ('ACT_SITE', 'BINDING', 'METAL', 'NP_BIND') THEN d END) AS act FROM dist GROUP BY key),
sig AS (SELECT protein, arg_min(fend, fstart * 1000 + fend) AS c FROM feat WHERE ftype = 'SIGNAL' GROUP BY protein),
joined AS (
  SELECT o.key, tm, act, c, CASE WHEN o.start <= c AND c <= o."end" THEN 0
         ELSE least(abs(c - o.start), abs(c - o."end")) END AS cd
  FROM occ o LEFT JOIN near USING (key) LEFT JOIN sig ON sig.protein = o.protein)
SELECT key, tm AS nearest_tm_distance, act AS nearest_active_site_distance, c AS signal_cleavage_pos,
       CASE WHEN c IS NOT NULL THEN cd END AS nearest_signal_cleavage_distance,
       concat_ws(';', CASE WHEN tm <= 30 THEN 'NearTransmembraneHelix' END,
                 CASE WHEN c IS NOT NULL AND cd <= 20 THEN 'NearSignalPeptideCleavage' END,
                 CASE WHEN act <= 10 THEN 'NearActiveSiteRegion' END) AS proximity_categories
FROM joined""")
def proximity(spark, sf):
    return iv.proximity(occurrences(spark, sf), features(spark, sf), "key").select(
        "key", "nearest_tm_distance", "nearest_active_site_distance", "signal_cleavage_pos",
        "nearest_signal_cleavage_distance", "proximity_categories",
    )


@query("j05_nearest_by_segment", f"""WITH {OCC}, {FEAT}, {SEG},
near AS (SELECT s.key, min(greatest(f.fstart - s.e1, s.s1 - f.fend, 0)) AS d
         FROM seg s JOIN feat f ON s.protein = f.protein WHERE f.ftype = 'TRANSMEM' GROUP BY s.key)
SELECT key, d AS nearest_tm_distance FROM occ LEFT JOIN near USING (key)""")
def nearest_by_segment(spark, sf):
    tm = features(spark, sf).filter("ftype = 'TRANSMEM'")
    return iv.nearest_distance(segmented(occurrences(spark, sf)), tm, "key", "nearest_tm_distance", segments="segments").select(
        "key", "nearest_tm_distance"
    )


@query("j07_binding_targets", f"""WITH {OCC}, {FEAT}, {SEG},
hits AS (SELECT DISTINCT s.key, replace(ligand, 'ChEBI:', 'CHEBI:') AS lig FROM seg s JOIN feat f
         ON s.protein = f.protein AND s.s1 <= f.fend AND f.fstart <= s.e1 WHERE ftype = 'BINDING'),
agg AS (SELECT key, string_agg(lig, ';' ORDER BY lig) AS t FROM hits GROUP BY key)
SELECT key, coalesce(t, '') AS binding_target_chebi,
       CASE WHEN t IS NULL THEN 'None' ELSE 'UniProtFT:ligand_id' END AS binding_target_class_evidence
FROM occ LEFT JOIN agg USING (key)""")
def binding(spark, sf):
    return iv.binding_targets(segmented(occurrences(spark, sf)), features(spark, sf), "key", segments="segments").select(
        "key", "binding_target_chebi", "binding_target_class_evidence"
    )


@query("j08_signature_assignment", f"""WITH {OCC},
inst AS (SELECT protein, label, key, start, "end", row_number() OVER (PARTITION BY protein ORDER BY key) AS position FROM occ WHERE flag <> 'R'),
sig AS (SELECT protein, label, key AS signature, start AS ss, "end" AS se FROM occ WHERE flag = 'R'),
hits AS (
  SELECT s.protein, signature, i.key, position, least(se, "end") - greatest(ss, start) + 1 AS ov,
         (least(se, "end") - greatest(ss, start) + 1) / least(se - ss + 1, "end" - start + 1) AS frac
  FROM sig s JOIN inst i ON s.protein = i.protein AND s.label = i.label AND ss <= "end" AND start <= se),
scored AS (
  SELECT *, ov >= 10 AND frac >= 0.2 AS good FROM hits),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY protein, signature
         ORDER BY good DESC, CASE WHEN good THEN frac * 1000 + ov ELSE 0 END DESC, position) AS rk FROM scored)
SELECT protein, signature, key AS instance, good AS above_threshold FROM ranked WHERE rk = 1""")
def signatures(spark, sf):
    from annospan.operators.ordered import ordered_scan, row_number

    occ = occurrences(spark, sf)
    inst = ordered_scan(occ.filter("flag <> 'R'"), ["protein"], F.substring("key", 1, 0), ["key"], position=row_number())
    inst = inst.select("protein", F.col("label").alias("acc"), F.col("key").alias("instance"), "position", "start", "end")
    sig = occ.filter("flag = 'R'").select(
        "protein", F.col("label").alias("acc"), F.col("key").alias("signature"), F.col("start").alias("sstart"), F.col("end").alias("send")
    )
    return iv.assign_signatures(inst, sig)


@query("j09_structural_context", f"""WITH {OCC}, {FEAT},
hits AS (
  SELECT DISTINCT o.key, f.superfamily FROM occ o JOIN feat f ON o.protein = f.protein
  WHERE least(o."end", f.fend) - greatest(o.start, f.fstart) + 1 >= 30
    AND (least(o."end", f.fend) - greatest(o.start, f.fstart) + 1) / least(o."end" - o.start + 1, f.fend - f.fstart + 1) >= 0.5),
agg AS (SELECT key, string_agg(superfamily, ';' ORDER BY superfamily) AS t FROM hits GROUP BY key)
SELECT key, coalesce(t, '') AS cath_superfamilies,
       CASE WHEN t IS NULL THEN '' ELSE 'predicted_gene3d' END AS structural_coverage_quality,
       CASE WHEN t IS NULL THEN 'None' ELSE 'InterProStructuralHitsOverlap' END AS structural_context_evidence
FROM occ LEFT JOIN agg USING (key)""")
def structural(spark, sf):
    hits = features(spark, sf).select("protein", F.col("fstart").alias("hstart"), F.col("fend").alias("hend"), "superfamily")
    return iv.structural_context(occurrences(spark, sf), hits, "key").select(
        "key", "cath_superfamilies", "structural_coverage_quality", "structural_context_evidence"
    )


@query("j10_insertion", f"""WITH {OCC}, {SEG},
gaps AS (SELECT key AS owner, protein, min(e1) + 1 AS gs, max(s1) - 1 AS ge FROM seg GROUP BY key, protein HAVING count(*) > 1),
ins AS (SELECT DISTINCT owner FROM gaps g JOIN occ o ON g.protein = o.protein AND o.key <> owner
        WHERE least(o."end", ge) - greatest(o.start, gs) + 1 >= 10)
SELECT key, CASE WHEN owner IS NULL THEN '' ELSE 'InsertedDomain' END AS insertion_category
FROM occ LEFT JOIN ins ON owner = key""")
def insertion(spark, sf):
    return iv.insertion_category(segmented(occurrences(spark, sf)), "key").select("key", "insertion_category")


@query("j11_cooccurring_occurrences", f"""WITH {GROUPS},
labelled AS (SELECT protein, key, ordinal_position_all AS o, acc || '|' || start || '..' || "end" || '|ord' || ordinal_position_all AS t FROM grouped)
SELECT a.protein, a.key, b.key AS other_key, b.t AS other_label, b.o AS other_position FROM labelled a JOIN labelled b ON a.protein = b.protein AND a.key <> b.key""")
def cooccurring(spark, sf):
    grouped = iv.overlap_groups(occurrences(spark, sf), tie=["acc", *TIE])
    label = F.concat(
        F.col("acc"), F.lit("|"), F.concat_ws("..", text("start"), text("end")), F.lit("|ord"), text("ordinal_position_all")
    )
    return iv.cooccurring_occurrences(grouped.withColumn("label", label), "key")


@query("j11_cooccurring_types", f"""WITH {OCC}, t AS (SELECT DISTINCT protein, acc FROM occ)
SELECT o.protein, o.key, coalesce(string_agg(t.acc, ';' ORDER BY t.acc), '') AS cooccurring_domain_types
FROM occ o LEFT JOIN t ON o.protein = t.protein AND o.acc <> t.acc GROUP BY o.protein, o.key""")
def cooccurring_types(spark, sf):
    return iv.cooccurring_types(occurrences(spark, sf), "key")
