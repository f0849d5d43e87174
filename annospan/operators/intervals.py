"""Interval operators: order, overlap groups, neighbours, range joins, nearest features.

Coordinates are 1-based and inclusive. ``entity`` names the column of the
sequence an interval lies on. Range joins and ordered scans cut an entity into
coordinate bins, so one very long or very crowded entity spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import ordinal_label
from annospan.functions.spans import overlap_len
from annospan.operators.blocks import co_members
from annospan.operators.ordered import (
    following,
    min_ahead,
    ordered_scan,
    previous,
    row_number,
    running_max,
    running_sum,
)
from annospan.session import materialise

BIN = 512


def coordinate_bin(pos: Column | str, width: int = BIN) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / width).cast("int")


def overlap_groups(
    df: DataFrame,
    entity: str = "protein",
    start: str = "start",
    end: str = "end",
    tie: Sequence[str] = ("acc",),
    width: int = BIN,
) -> DataFrame:
    """Ordinal of every interval and the island of overlapping intervals it is in.

    A new group begins where ``start`` exceeds the running maximum of all
    earlier ends; ``start`` equal to that maximum stays in the group.
    """
    order = [start, end, *tie]
    binned = df.withColumn("__bin", coordinate_bin(start, width))
    ranked = ordered_scan(
        binned, [entity], "__bin", order,
        ordinal_position_all=row_number(),
        __reach=running_max(F.col(end), exclusive=True),
    )
    opens = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0)
    grouped = ordered_scan(ranked, [entity], "__bin", order, overlap_group_id=running_sum(opens))
    return grouped.drop("__reach", "__bin")


def representatives(
    grouped: DataFrame,
    entity: str = "protein",
    start: str = "start",
    end: str = "end",
    acc: str = "acc",
    tie: Sequence[str] = (),
    keep: Sequence[str] = (),
    width: int = BIN,
) -> DataFrame:
    """One row per overlap group: longest member, its neighbours, gaps, adjacency and N/C label.

    For each column of ``keep`` the value of the representative and of its two
    neighbours is added (``rep_x``, ``prev_x``, ``next_x``).
    """
    length = F.col(end) - F.col(start) + 1
    best = F.struct((-length).alias("neg"), F.col(start).alias("s"), F.col(acc).alias("a"), *tie)
    info = F.struct(
        F.col(start).alias("rep_start"), F.col(end).alias("rep_end"), F.col(acc).alias("rep_acc"),
        *[F.col(t).alias(f"rep_{t}") for t in (*tie, *keep)],
    )
    reps = (
        grouped.groupBy(entity, "overlap_group_id")
        .agg(F.count(F.lit(1)).alias("overlap_group_size"), F.min_by(info, best).alias("__r"))
        .select(entity, "overlap_group_id", "overlap_group_size", "__r.*")
    )
    near = F.struct(
        F.col("rep_start").alias("s"), F.col("rep_end").alias("e"), F.col("rep_acc").alias("t"),
        *[F.col(f"rep_{k}").alias(f"k_{k}") for k in keep],
    )
    scanned = ordered_scan(
        reps, [entity], coordinate_bin("rep_start", width), ["rep_start", "rep_end", "rep_acc"],
        __p=previous(near), __n=following(near),
    )
    groups = grouped.groupBy(entity).agg(F.max("overlap_group_id").alias("__groups"))
    gap_prev = F.col("rep_start") - F.col("__p.e")
    gap_next = F.col("__n.s") - F.col("rep_end")
    return scanned.join(groups, entity).select(
        *reps.columns,
        F.col("__p.t").alias("prev_domain_type"),
        F.col("__n.t").alias("next_domain_type"),
        *[F.col(f"__p.k_{k}").alias(f"prev_{k}") for k in keep],
        *[F.col(f"__n.k_{k}").alias(f"next_{k}") for k in keep],
        gap_prev.alias("gap_from_prev"),
        gap_next.alias("gap_to_next"),
        (gap_prev <= 1).alias("adjacent_to_prev"),
        (gap_next <= 1).alias("adjacent_to_next"),
        ordinal_label(F.col("overlap_group_id"), F.col("__groups")).alias("ordinal_label_nc"),
    )


def domain_order(
    df: DataFrame,
    entity: str = "protein",
    start: str = "start",
    end: str = "end",
    acc: str = "acc",
    tie: Sequence[str] = (),
    width: int = BIN,
) -> DataFrame:
    """Full order annotation: groups, representative, relation to it, neighbours.

    Gaps and adjacency are filled for representatives only, neighbour types for
    every member of the group.
    """
    grouped = materialise(overlap_groups(df, entity, start, end, (acc, *tie), width), "groups")
    reps = representatives(grouped, entity, start, end, acc, tie, width=width)
    joined = grouped.join(reps, [entity, "overlap_group_id"])
    s, e = F.col(start), F.col(end)
    same = (s == F.col("rep_start")) & (e == F.col("rep_end")) & (F.col(acc) == F.col("rep_acc"))
    for t in tie:
        same = same & (F.col(t) == F.col(f"rep_{t}"))
    relation = (
        F.when(same, "self")
        .when((F.col("rep_start") <= s) & (e <= F.col("rep_end")), "contained_in_rep")
        .when((s <= F.col("rep_start")) & (F.col("rep_end") <= e), "contains_rep")
        .otherwise("overlaps_rep")
    )
    only_rep = {
        c: F.when(same, F.col(c)) for c in ("gap_from_prev", "gap_to_next", "adjacent_to_prev", "adjacent_to_next")
    }
    return (
        joined.withColumn("is_representative", same)
        .withColumn("overlap_relation_to_rep", relation)
        .withColumns(only_rep)
        .withColumn("ordinal_position_group", F.col("overlap_group_id"))
        .withColumnRenamed("rep_acc", "representative_type")
        .drop(*[f"rep_{t}" for t in tie])
    )


EDGE = [
    "gap_from_prev", "gap_to_next", "adjacent_to_prev", "adjacent_to_next", "ordinal_label_nc", "edge_scope",
]


def order_edges(
    df: DataFrame, occurrence: str, entity: str = "protein", start: str = "start", end: str = "end", acc: str = "acc",
    tie: Sequence[str] = (), width: int = BIN,
) -> DataFrame:
    """One edge row per representative: neighbours, gaps and N / N+k / C label."""
    narrow = df.select(entity, occurrence, start, end, acc, *tie)
    grouped = materialise(overlap_groups(narrow, entity, start, end, (acc, *tie), width), "groups")
    reps = representatives(grouped, entity, start, end, acc, tie, [occurrence], width)
    return reps.withColumn("edge_scope", F.lit("representatives")).select(
        entity, F.col(f"rep_{occurrence}").alias("occurrence_id"),
        F.col(f"prev_{occurrence}").alias("prev_occurrence_id"), F.col(f"next_{occurrence}").alias("next_occurrence_id"), *EDGE,
    )


def order_edges_all(
    df: DataFrame, occurrence: str, entity: str = "protein", start: str = "start", end: str = "end", acc: str = "acc",
    width: int = BIN,
) -> DataFrame:
    """The same edges over every occurrence, for tables without representatives."""
    near = F.struct(F.col(occurrence).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"))
    scanned = ordered_scan(
        df.select(entity, occurrence, start, end, acc), [entity], coordinate_bin(start, width),
        [start, end, acc, occurrence], __k=row_number(), __p=previous(near), __n=following(near),
    )
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__size"))
    gap_prev, gap_next = F.col(start) - F.col("__p.e"), F.col("__n.s") - F.col(end)
    return scanned.join(sizes, entity).select(
        entity, F.col(occurrence).alias("occurrence_id"),
        F.col("__p.o").alias("prev_occurrence_id"),
        F.col("__n.o").alias("next_occurrence_id"),
        gap_prev.alias("gap_from_prev"),
        gap_next.alias("gap_to_next"),
        (gap_prev <= 1).alias("adjacent_to_prev"),
        (gap_next <= 1).alias("adjacent_to_next"),
        ordinal_label(F.col("__k"), F.col("__size")).alias("ordinal_label_nc"),
        F.lit("all_occurrences").alias("edge_scope"),
    )


def copy_number(df: DataFrame, entity: str = "protein", acc: str = "acc") -> DataFrame:
    """Occurrences of the same type on the same entity (aggregate, then join)."""
    counts = df.groupBy(entity, acc).agg(F.count(F.lit(1)).alias("copy_number"))
    return df.join(counts, [entity, acc])


def canonical_instances(df: DataFrame, segments: str = "segments") -> DataFrame:
    """Span and continuity of an entry location given as a segment array."""
    seg = F.array_sort(F.filter(F.col(segments), lambda g: g["start"] <= g["end"]))
    return (
        df.withColumn(segments, seg)
        .filter(F.size(segments) > 0)
        .withColumn("start", F.array_min(F.transform(segments, lambda g: g["start"])))
        .withColumn("end", F.array_max(F.transform(segments, lambda g: g["end"])))
        .withColumn(
            "continuity_category",
            F.when(F.size(segments) > 1, "DiscontinuousDomain").otherwise("ContinuousDomain"),
        )
    )


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = coordinate_bin(start, width), coordinate_bin(end, width)
    return df.filter(F.col(start) <= F.col(end)).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[str, str] = ("start", "end"),
    right_span: tuple[str, str] = ("fstart", "fend"),
    width: int = BIN,
) -> DataFrame:
    """All overlapping pairs with their overlap length, each exactly once.

    Both sides are expanded into bins and joined on (keys, bin); a pair that
    shares several bins is kept in the first one only, so no de-duplication
    shuffle follows. Apart from ``on`` the two sides must not share column names.
    """
    (s1, e1), (s2, e2) = left_span, right_span
    joined = _binned(left, s1, e1, width).join(_binned(right, s2, e2, width), [*on, "__bin"])
    first_shared = F.greatest(coordinate_bin(s1, width), coordinate_bin(s2, width))
    hits = joined.filter(
        (F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1)) & (F.col("__bin") == first_shared)
    )
    return hits.drop("__bin").withColumn("overlap", overlap_len(F.col(s1), F.col(e1), F.col(s2), F.col(e2)))


def attach_sets(df: DataFrame, key: str, rows: DataFrame, value: str, name: str) -> DataFrame:
    """Left join the sorted distinct ``value`` tokens collected per ``key``."""
    sets = (
        rows.select(key, value).distinct().groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_list(value)), ";").alias(name))
    )
    return df.join(sets, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


# Words in a topology note and the context they stand for.
TOPOLOGY_WORDS = [
    ("cytoplasmic", ["cytoplasm"]),
    ("extracellular", ["extracellular", "cell surface", "periplasmic"]),
    ("luminal", ["lumenal", "lumen", "luminal"]),
]
BINDING_TYPES = ["BINDING", "NP_BIND", "METAL"]
ACTIVE_TYPES = ["ACT_SITE", "BINDING", "METAL", "NP_BIND"]
DISORDER_TYPES = ["DISORDER", "COMPBIAS"]


def topology_of(ftype: Column, note: Column) -> Column:
    """Context a feature gives to what it overlaps; null for other features."""
    text = F.lower(F.coalesce(note, F.lit("")))
    by_note = F.lit(None).cast("string")
    for context, words in reversed(TOPOLOGY_WORDS):
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        by_note = F.when(hit, context).otherwise(by_note)
    return (
        F.when(ftype == "TOPO_DOM", by_note)
        .when(ftype == "TRANSMEM", "transmembrane")
        .when(ftype == "SIGNAL", "signal_peptide")
    )


def topology_context(iv: DataFrame, feat: DataFrame, key: str, entity: str = "protein", width: int = BIN) -> DataFrame:
    """Topology set and binding-site tokens of the features an interval overlaps."""
    marked = feat.select(
        entity, "fstart", "fend",
        topology_of(F.col("ftype"), F.col("note")).alias("__ctx"),
        F.when(
            F.col("ftype").isin(BINDING_TYPES),
            F.concat(
                F.col("ftype"), F.lit(":"), F.col("fstart").cast("string"), F.lit(".."),
                F.col("fend").cast("string"), F.lit(":"), F.coalesce("note", F.lit("")),
            ),
        ).alias("__site"),
    ).filter("__ctx is not null or __site is not null")
    hits = overlap_join(iv.select(entity, key, "start", "end"), marked, [entity], width=width)
    tokens = hits.select(key, "__ctx", "__site").distinct()
    sets = tokens.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("__ctx")), ";").alias("__c"),
        F.array_join(F.array_sort(F.collect_set("__site")), ";").alias("binding_site_types"),
    )
    found = iv.join(sets, key, "left")
    ctx = F.nullif("__c", F.lit(""))
    sites = F.coalesce("binding_site_types", F.lit(""))
    return (
        found.withColumn("topology_context", F.coalesce(ctx, F.lit("unknown")))
        .withColumn("topology_evidence", F.when(ctx.isNull(), "NoTopologyFeatures").otherwise("FromUniProtFT"))
        .withColumn("binding_site_types", sites)
        .withColumn("binding_site_evidence", F.when(F.col("binding_site_types") == "", "NoBindingSites").otherwise("FromUniProtFT"))
        .drop("__c")
    )


def disorder_status(
    iv: DataFrame, feat: DataFrame, key: str, entity: str = "protein",
    high: float = 0.7, low: float = 0.3, width: int = BIN,
) -> DataFrame:
    """Summed overlap with disorder features over the length of the interval."""
    hits = overlap_join(iv.select(entity, key, "start", "end"), feat.select(entity, "fstart", "fend"), [entity], width=width)
    covered = hits.groupBy(key).agg(F.sum("overlap").alias("__ov"))
    known = feat.filter("fstart <= fend").select(entity).distinct().withColumn("__known", F.lit(True))
    frac = F.coalesce("__ov", F.lit(0)) / (F.col("end") - F.col("start") + 1)
    status = (
        F.when(F.col("__known").isNull() | (F.col("end") < F.col("start")), "unknown")
        .when(frac >= high, "disordered")
        .when(frac <= low, "structured")
        .otherwise("mixed")
    )
    return (
        iv.join(covered, key, "left").join(known, entity, "left")
        .withColumn("disorder_status", status)
        .withColumn("disorder_evidence", F.when(F.col("__known"), "FromUniProtFT").otherwise("NoDisorderFeatures"))
        .drop("__ov", "__known")
    )


def nearest_distance(
    iv: DataFrame, feat: DataFrame, key: str, name: str, entity: str = "protein", width: int = BIN,
    segments: str | None = None,
) -> DataFrame:
    """Distance to the nearest feature on the entity (0 on overlap, null without features).

    Intervals and features are merged into one coordinate order; the nearest
    feature is the one with the largest end before, or the smallest start after.
    Linear in the rows, no pairs are formed.
    """
    spans = iv.select(entity, key, "start", "end")
    if segments:
        spans = iv.select(entity, key, F.explode(segments).alias("g")).select(
            entity, key, F.col("g.start").alias("start"), F.col("g.end").alias("end")
        )
    none = F.lit(None).cast("int")
    events = spans.select(
        entity, key, F.col("start").alias("pos"), F.col("end").alias("stop"), F.lit(1).alias("side"),
        none.alias("fs"), none.alias("fe"),
    ).unionByName(
        feat.filter("fstart <= fend").select(
            entity, F.col("fstart").alias("pos"), F.col("fend").alias("stop"), F.lit(0).alias("side"),
            F.col("fstart").alias("fs"), F.col("fend").alias("fe"),
        ),
        allowMissingColumns=True,
    )
    scanned = ordered_scan(
        events, [entity], coordinate_bin("pos", width), ["pos", "side", "stop", key],
        __before=running_max(F.col("fe")), __after=min_ahead(F.col("fs")),
    ).filter("side = 1")
    clip = lambda d: F.when(d > 0, d).when(d.isNotNull(), 0)
    gap = F.least(clip(F.col("pos") - F.col("__before")), clip(F.col("__after") - F.col("stop")))
    best = scanned.groupBy(key).agg(F.min(gap).alias(name))
    return iv.join(best, key, "left")


def cleavage_distance(iv: DataFrame, feat: DataFrame, entity: str = "protein") -> DataFrame:
    """Distance to the end of the first SIGNAL feature of the entity."""
    first = (
        feat.filter((F.col("ftype") == "SIGNAL") & (F.col("fstart") <= F.col("fend")))
        .groupBy(entity)
        .agg(F.min(F.struct("fstart", "fend"))["fend"].alias("signal_cleavage_pos"))
    )
    c, s, e = F.col("signal_cleavage_pos"), F.col("start"), F.col("end")
    dist = F.when((s <= c) & (c <= e), 0).otherwise(F.least(F.abs(c - s), F.abs(c - e)))
    return iv.join(first, entity, "left").withColumn("nearest_signal_cleavage_distance", dist)


def proximity(
    iv: DataFrame, feat: DataFrame, key: str, entity: str = "protein",
    near_tm: int = 30, near_cleavage: int = 20, near_active: int = 10, width: int = BIN,
    segments: str | None = None,
) -> DataFrame:
    """Nearest transmembrane, cleavage and active-site distances and their categories."""
    tm = feat.filter(F.col("ftype") == "TRANSMEM")
    active = feat.filter(F.col("ftype").isin(ACTIVE_TYPES))
    out = nearest_distance(iv, tm, key, "nearest_tm_distance", entity, width, segments)
    out = cleavage_distance(out, feat, entity)
    out = nearest_distance(out, active, key, "nearest_active_site_distance", entity, width, segments)
    cats = F.concat_ws(
        ";",
        F.when(F.col("nearest_tm_distance") <= near_tm, "NearTransmembraneHelix"),
        F.when(F.col("nearest_signal_cleavage_distance") <= near_cleavage, "NearSignalPeptideCleavage"),
        F.when(F.col("nearest_active_site_distance") <= near_active, "NearActiveSiteRegion"),
    )
    return out.withColumn("proximity_categories", cats)


def binding_targets(
    iv: DataFrame, feat: DataFrame, key: str, entity: str = "protein", width: int = BIN, segments: str | None = None,
) -> DataFrame:
    """Ligand identifiers of binding features that overlap any segment."""
    spans = iv.select(entity, key, "start", "end")
    if segments:
        spans = iv.select(entity, key, F.explode(segments).alias("g")).select(
            entity, key, F.col("g.start").alias("start"), F.col("g.end").alias("end")
        )
    ligand = F.regexp_replace("ligand", "ChEBI:", "CHEBI:")
    sites = feat.filter(
        F.col("ftype").isin(BINDING_TYPES) & F.upper("ligand").contains("CHEBI:")
    ).select(entity, "fstart", "fend", ligand.alias("__lig"))
    hits = overlap_join(spans, sites, [entity], width=width)
    out = attach_sets(iv, key, hits, "__lig", "binding_target_chebi")
    return out.withColumn(
        "binding_target_class_evidence",
        F.when(F.col("binding_target_chebi") == "", "None").otherwise("UniProtFT:ligand_id"),
    )


def assign_signatures(
    instances: DataFrame, signatures: DataFrame, entity: str = "protein", min_aa: int = 10, min_frac: float = 0.2,
    width: int = BIN,
) -> DataFrame:
    """Best instance for every member signature.

    instances: entity, acc, instance, start, end, position (input order);
    signatures: entity, acc (the integrated entry), signature, sstart, send.
    Instances that pass both thresholds compete on ``1000 * fraction + overlap``;
    without one the first overlapping instance in input order is taken.
    """
    hits = overlap_join(
        instances.select(entity, "acc", "instance", "position", "start", "end"),
        signatures.select(entity, "acc", "signature", "sstart", "send"),
        [entity, "acc"], right_span=("sstart", "send"), width=width,
    )
    shorter = F.least(F.col("end") - F.col("start") + 1, F.col("send") - F.col("sstart") + 1)
    frac = F.col("overlap") / shorter
    good = (F.col("overlap") >= min_aa) & (frac >= min_frac)
    rank = F.struct(
        good.alias("good"),
        F.when(good, frac * 1000 + F.col("overlap")).otherwise(F.lit(0.0)).alias("score"),
        (-F.col("position")).alias("first"),
    )
    return hits.groupBy(entity, "signature").agg(
        F.max_by("instance", rank).alias("instance"), F.max(rank)["good"].alias("above_threshold")
    )


def structural_context(
    iv: DataFrame, hits: DataFrame, key: str, entity: str = "protein", min_aa: int = 30, min_frac: float = 0.5,
    width: int = BIN,
) -> DataFrame:
    """Superfamilies of structural hits that cover enough of the shorter interval.

    hits: entity, hstart, hend, superfamily.
    """
    pairs = overlap_join(
        iv.select(entity, key, "start", "end"), hits.select(entity, "hstart", "hend", "superfamily"), [entity],
        right_span=("hstart", "hend"), width=width,
    )
    shorter = F.least(F.col("end") - F.col("start") + 1, F.col("hend") - F.col("hstart") + 1)
    good = pairs.filter((F.col("overlap") >= min_aa) & (F.col("overlap") / shorter >= min_frac))
    out = attach_sets(iv, key, good.filter("superfamily <> ''"), "superfamily", "cath_superfamilies")
    has = F.col("cath_superfamilies") != ""
    return out.withColumn(
        "structural_coverage_quality", F.when(has, "predicted_gene3d").otherwise("")
    ).withColumn("structural_context_evidence", F.when(has, "InterProStructuralHitsOverlap").otherwise("None"))


def insertion_category(
    iv: DataFrame, key: str, entity: str = "protein", segments: str = "segments", min_aa: int = 10, width: int = BIN,
) -> DataFrame:
    """Does another interval reach at least ``min_aa`` into a gap between segments?"""
    gaps = (
        iv.filter(F.size(segments) > 1)
        .withColumn("__s", F.array_sort(segments))
        .select(
            entity, F.col(key).alias("__owner"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("__s") - 1),
                    lambda i: F.struct(
                        (F.get("__s", i - 1)["end"] + 1).alias("gs"), (F.get("__s", i)["start"] - 1).alias("ge")
                    ),
                )
            ).alias("g"),
        )
        .select(entity, "__owner", "g.gs", "g.ge")
    )
    hits = overlap_join(iv.select(entity, key, "start", "end"), gaps, [entity], right_span=("gs", "ge"), width=width)
    inserted = (
        hits.filter((F.col(key) != F.col("__owner")) & (F.col("overlap") >= min_aa))
        .select(F.col("__owner").alias(key)).distinct().withColumn("__ins", F.lit("InsertedDomain"))
    )
    return iv.join(inserted, key, "left").withColumn(
        "insertion_category", F.coalesce("__ins", F.lit(""))
    ).drop("__ins")


def cooccurring_occurrences(
    df: DataFrame, key: str, entity: str = "protein", label: str = "label", position: str = "ordinal_position_all", block: int = 256
) -> DataFrame:
    """(entity, key, other_key, other_label, other_position): the other occurrences on the entity, one row each.

    The long form is the contract at any size: a crowded entity is met in blocks
    (``co_members``), so neither a task nor a cell holds all of it.
    """
    rows = df.select(entity, key, F.struct(F.col(label).alias("label"), F.col(position).alias("position")).alias("__p"))
    pairs = co_members(rows, entity, key, ["__p"], block)
    one = lambda x, y: F.struct(F.col(f"{x}.{key}").alias("k"), F.col(f"{y}.{key}").alias("o"), F.col(f"{y}.__p").alias("p"))
    both = pairs.select(entity, F.explode(F.array(one("a", "b"), one("b", "a"))).alias("x"))
    return both.select(
        entity, F.col("x.k").alias(key), F.col("x.o").alias("other_key"), F.col("x.p.label").alias("other_label"), F.col("x.p.position").alias("other_position")
    )


def cooccurring_types(df: DataFrame, key: str, entity: str = "protein", acc: str = "acc") -> DataFrame:
    """The other types on the entity (distinct, sorted)."""
    types = (
        df.select(entity, acc).distinct().groupBy(entity)
        .agg(F.array_sort(F.collect_list(acc)).alias("__types"))
    )
    rest = F.array_join(F.array_except("__types", F.array(acc)), ";")
    return df.select(entity, key, acc).join(types, entity).select(
        entity, key, rest.alias("cooccurring_domain_types")
    )
