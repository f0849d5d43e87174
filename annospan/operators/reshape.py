"""Projections, filters and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import blank_to_null, missing, safe_int, split_cell
from annospan.operators.common import attach

# Annotation columns, their predicate and category.
ANNOTATION_COLUMNS = [
    ("domain_type_id", "hasDomainType", "domain_type"),
    ("function_tags", "hasFunctionTag", "function"),
    ("topology_context", "hasTopologyContext", "topology"),
    ("positional_category", "hasPositionalCategory", "position"),
    ("copy_number_property", "hasCopyNumberProperty", "copy_number"),
    ("proximity_categories", "hasProximityCategory", "proximity"),
    ("binding_partner", "hasBindingTarget", "binding_target"),
    ("go_terms_mf", "hasGOTermMF", "GO_function"),
    ("go_terms_bp", "hasGOTermBP", "GO_process"),
    ("go_terms_cc", "hasGOTermCC", "GO_component"),
]
# May a category be transferred when the rule table is silent?
DEFAULT_TRANSFERABLE = {
    "domain_type": True,
    "function": True,
    "topology": True,
    "position": True,
    "copy_number": True,
    "proximity": True,
    "binding_target": False,
    "GO_function": True,
    "GO_process": False,
    "GO_component": False,
}
STRUCTURAL_CATEGORIES = ["domain_type", "topology", "position", "proximity"]
# Fixed value: names left out by the record filter.
UNCERTAIN_NAMES = r"(?i)hypothetical|putative|like"
# Accepted curation states of a pair.
APPROVED = ["high_confidence", "high confidence", "yes", "approved"]


def canonicalise(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rename the first existing alias of each canonical column that is absent."""
    renames, taken = {}, set(df.columns)
    for name, options in aliases.items():
        found = next((o for o in options if o in taken and o not in renames), None)
        if name not in taken and found:
            renames[found] = name
    return df.withColumnsRenamed(renames)


def require(df: DataFrame, core: Sequence[str], soft: Sequence[str] = ()) -> dict[str, list[str]]:
    """Missing columns by severity; a missing core column raises."""
    lacking = [c for c in core if c not in df.columns]
    if lacking:
        raise ValueError(f"missing required columns: {', '.join(lacking)}")
    return {"warn": [c for c in soft if c not in df.columns]}


def column_check(df: DataFrame, tiers: dict[str, Sequence[str]]) -> DataFrame:
    """One row per expected column: tier and whether the table has it."""
    rows = [(tier, c, c in df.columns) for tier, cols in tiers.items() for c in cols]
    return df.sparkSession.createDataFrame(rows, "tier string, column_name string, present boolean")


def explode_tokens(df: DataFrame, col: str, row_id: str, delimiter: str = ";") -> DataFrame:
    """One row per token with its row id and position."""
    return df.select(row_id, F.posexplode(split_cell(col, delimiter)).alias("position", "token"))


def filter_records(
    df: DataFrame, accession: str, name: str, order: Sequence[str], pattern: str = UNCERTAIN_NAMES
) -> tuple[DataFrame, DataFrame]:
    """Kept rows and dropped rows with their reason.

    Reasons in order: no accession, repeated accession (all but the first by
    ``order``), name matches the pattern.
    """
    firsts = df.filter(~missing(accession)).groupBy(accession).agg(F.min(F.struct(*order)).alias("__first"))
    reason = (
        F.when(missing(accession), "missing_accession")
        .when(F.struct(*order) != F.col("__first"), "duplicate_accession")
        .when(F.col(name).rlike(pattern), "excluded_by_name")
    )
    marked = df.join(firsts, accession, "left").withColumn("reason", reason).drop("__first")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def with_coords(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumns({start: safe_int(start), end: safe_int(end)}).filter(
        F.col(start).isNotNull() & F.col(end).isNotNull()
    )


def entity_feature_pairs(df: DataFrame, entity: str, feature: str) -> DataFrame:
    """Distinct (entity, feature) pairs without blanks."""
    return df.filter(~missing(entity) & ~missing(feature)).select(entity, feature).distinct()


def label_template(df: DataFrame, entity: str, helpers: Sequence[str]) -> DataFrame:
    """One row per entity with an empty group and the first value of each helper column."""
    aggs = [F.min(blank_to_null(h)).alias(h) for h in helpers]
    return df.filter(~missing(entity)).groupBy(entity).agg(*aggs).withColumn("protein_group", F.lit(""))


def load_rules(rules: DataFrame | None, spark) -> DataFrame:
    """(annotation_category, is_transferable): the table's value, else the default."""
    base = spark.createDataFrame(
        list(DEFAULT_TRANSFERABLE.items()), "annotation_category string, __default boolean"
    )
    if rules is None:
        return base.withColumnRenamed("__default", "is_transferable")
    given = rules.select(
        "annotation_category", F.lower(F.trim(F.col("transferable").cast("string"))).isin("yes", "true", "1").alias("__given")
    )
    return base.join(given, "annotation_category", "full").select(
        "annotation_category",
        F.coalesce("__given", "__default", F.lit(False)).alias("is_transferable"),
    )


def annotations_long(
    df: DataFrame, entity: str, rules: DataFrame | None = None, columns=ANNOTATION_COLUMNS, delimiter: str = ";"
) -> DataFrame:
    """(entity, annotation_category, predicate, term_value, is_transferable), distinct."""
    present = [(c, p, k) for c, p, k in columns if c in df.columns]
    cells = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), split_cell(c, delimiter).alias("t")) for c, p, k in present]
    )
    long = (
        df.filter(~missing(entity))
        .select(entity, F.explode(cells).alias("c"))
        .select(
            entity, F.col("c.k").alias("annotation_category"), F.col("c.p").alias("predicate"),
            F.explode("c.t").alias("term_value"),
        )
        .filter("term_value <> 'nan'")
        .distinct()
    )
    flags = load_rules(rules, df.sparkSession)
    return long.join(flags, "annotation_category", "left").withColumn(
        "is_transferable", F.coalesce("is_transferable", F.lit(False))
    )


def annotations_structural(df: DataFrame, entity: str, delimiter: str = ";") -> DataFrame:
    """Only the structural categories: what a predictor may see of the target side."""
    columns = [c for c in ANNOTATION_COLUMNS if c[2] in STRUCTURAL_CATEGORIES]
    return annotations_long(df, entity, None, columns, delimiter).drop("is_transferable")


def occurrence_links(df: DataFrame, occurrence: str, tokens: Column, link_type: str, evidence: Column) -> DataFrame:
    """(occurrence, linked_id, linked_db, link_type, evidence) from a token array."""
    linked = df.select(occurrence, F.explode(tokens).alias("linked_id"), evidence.alias("evidence"))
    return linked.select(
        occurrence, "linked_id", F.substring_index("linked_id", ":", 1).alias("linked_db"),
        F.lit(link_type).alias("link_type"), "evidence",
    )


def approve_pairs(df: DataFrame, score_cut: float = 2.0) -> DataFrame:
    """Curated pairs; with none accepted the top tier; uncurated tables by score."""
    if "curation_status" not in df.columns:
        return df.filter(F.col("candidate_score") >= score_cut)
    ok = F.coalesce(F.lower(F.trim("curation_status")).isin(APPROVED), F.lit(False))
    curated = df.agg(F.coalesce(F.max(ok.cast("int")), F.lit(0)).alias("__any"))
    marked = attach(df.withColumn("__ok", ok), curated)
    top = F.lower("confidence_tier") == "high_confidence"
    return marked.filter(F.when(F.col("__any") == 1, F.col("__ok")).otherwise(top)).drop("__ok", "__any")


def restrict(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def cluster_flags(df: DataFrame, cluster: str, species: str, left: str = "human", right: str = "mouse") -> DataFrame:
    """Cluster size and which of the two species it holds, on every member row."""
    flags = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.max(F.col(species) == left).alias(f"has_{left}"),
        F.max(F.col(species) == right).alias(f"has_{right}"),
    )
    flags = flags.withColumn("cross_species_cluster", F.col(f"has_{left}") & F.col(f"has_{right}"))
    return df.join(flags, cluster)


# Accepted header variants of a pair table.
PAIR_ALIASES = {
    "human_accession": ["human_protein", "human_protein_accession", "species1_accession"],
    "other_accession": ["other_protein", "other_protein_accession", "species2_accession", "ortholog_accession"],
}


def load_pairs(df: DataFrame) -> DataFrame:
    """Canonical lower-case headers; both accession columns must exist."""
    cleaned = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    out = canonicalise(cleaned, PAIR_ALIASES)
    require(out, list(PAIR_ALIASES))
    return out
