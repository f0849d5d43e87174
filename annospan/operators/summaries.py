"""Aggregations: type summaries, tallies, co-occurrence, neighbours, fixed questions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospan.functions.cells import blank_to_null, missing, split_cell, split_multi
from annospan.operators.blocks import co_members
from annospan.operators.ordered import following, ordered_scan


def _text(col: Column) -> Column:
    return col.cast("string")


def sample_text(df: DataFrame, by: str, col: str, name: str, n: int = 50) -> DataFrame:
    """First ``n`` distinct values in order and ``... (+k more)``, without collecting the rest.

    Only the count and the ``n`` smallest values per group are gathered.
    """
    distinct = df.select(by, col).distinct()
    totals = distinct.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    first = top_k(distinct, [by], [col], n).groupBy(by).agg(
        F.array_join(F.array_sort(F.collect_list(col)), ", ").alias("__v")
    )
    more = F.when(
        F.col("__n") > n, F.concat(F.lit(", ... (+"), _text(F.col("__n") - n), F.lit(" more)"))
    ).otherwise("")
    return totals.join(first, by).select(by, F.concat("__v", more).alias(name))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int, parts: int = 64) -> DataFrame:
    """First ``k`` rows per group in two rounds: per (group, slice), then per group."""
    by = list(by)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    first = sliced.withColumn(
        "__k", F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*cols))
    ).filter(F.col("__k") <= k)
    return (
        first.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*cols)))
        .filter(F.col("__k") <= k).drop("__k", "__slice")
    )


def top_values(df: DataFrame, col: str, k: int, name: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), col).limit(k)


def modal(df: DataFrame, by: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min_by(col, F.struct(-F.col("__n"), F.col(col)))
    return counts.groupBy(*by).agg(best.alias(name or col))


def argmax(df: DataFrame, value: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    best = F.min_by(value, F.struct(-F.col(score), F.col(value)))
    return df.groupBy(*by).agg(best.alias(value), F.max(score).alias(score))


def tally(df: DataFrame, by: str, tokens: Column, name: str) -> DataFrame:
    """``value:count; ...`` per group, most frequent first; empty cells count as unknown."""
    filled = F.when(F.size(tokens) == 0, F.array(F.lit("unknown"))).otherwise(tokens)
    counts = df.select(by, F.explode(filled).alias("t")).groupBy(by, "t").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("t"), F.col("n"))))
    return counts.groupBy(by).agg(
        F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["t"], _text(x["n"]))), "; ").alias(name)
    )


def token_union(df: DataFrame, by: str, tokens: Column, name: str, max_items: int = 200) -> DataFrame:
    """Sorted distinct tokens per group, the first ``max_items`` of them as text."""
    distinct = df.select(by, F.explode(tokens).alias("t")).distinct()
    first = top_k(distinct, [by], ["t"], max_items)
    return first.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("t")), "; ").alias(name))


def length_stats(df: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Mean, exact median, minimum and maximum length per group.

    The median is read off a histogram of lengths, so a crowded type costs one
    row per distinct length rather than one per occurrence.
    """
    hist = (
        df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
        .groupBy(by, (F.col(end) - F.col(start) + 1).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(by).orderBy("len")
    total = F.sum("n").over(Window.partitionBy(by))
    cum = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.withColumns({"total": total, "cum": cum})
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    return ranked.groupBy(by).agg(
        F.round(F.sum(F.col("len") * F.col("n")) / F.first("total"), 2).alias("mean_domain_length"),
        F.round(
            (F.min(F.when(F.col("cum") >= low, F.col("len"))) + F.min(F.when(F.col("cum") >= high, F.col("len")))) / 2.0, 2
        ).alias("median_domain_length"),
        F.min("len").cast("long").alias("min_domain_length"),
        F.max("len").cast("long").alias("max_domain_length"),
    )


def copy_profile(df: DataFrame, by: str, entity: str, copies: str) -> DataFrame:
    """``copies:entities; ...`` from the largest copy number of a type on each entity."""
    per = df.groupBy(by, entity).agg(F.coalesce(F.max(copies), F.lit(0)).alias("c"))
    counts = per.groupBy(by, "c").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("c", "n")))
    return counts.groupBy(by).agg(
        F.array_join(F.transform(listed, lambda x: F.concat_ws(":", _text(x["c"]), _text(x["n"]))), "; ").alias(
            "copy_number_profile"
        )
    )


def summarise_types(
    occ: DataFrame,
    types: DataFrame | None = None,
    type_id: str = "domain_type_id",
    entity: str = "protein",
    gene: str = "gene",
    label: str = "label",
    tallies: Sequence[str] = (),
    unions: Sequence[str] = (),
    copies: str | None = None,
    sample: int = 50,
    max_items: int = 200,
) -> DataFrame:
    """One row per type: counts, lengths, tallies, unions, sample and best name."""
    occ = occ.filter(~missing(type_id))
    counts = occ.groupBy(type_id).agg(F.count(F.lit(1)).alias("n_occurrences"))
    out = (
        counts.join(_distinct_count(occ, type_id, entity, "n_proteins"), type_id, "left")
        .join(_distinct_count(occ, type_id, gene, "n_genes"), type_id, "left")
        .join(length_stats(occ, type_id), type_id, "left")
        .join(sample_text(occ.filter(~missing(entity)), type_id, entity, "protein_accessions", sample), type_id, "left")
    )
    for c in tallies:
        out = out.join(tally(occ, type_id, split_multi(c), f"{c}_counts"), type_id, "left")
    for c in unions:
        out = out.join(token_union(occ, type_id, split_multi(c), f"{c}_union", max_items), type_id, "left")
        out = out.withColumn(f"{c}_union", F.coalesce(f"{c}_union", F.lit("")))
    if copies:
        out = out.join(copy_profile(occ, type_id, entity, copies), type_id, "left")
    names = modal(occ.filter(~missing(label)), [type_id], label, "__modal")
    out = out.join(names, type_id, "left")
    if types is not None:
        dim = types.groupBy(type_id).agg(F.first(blank_to_null("name"), ignorenulls=True).alias("__name"))
        out = out.join(dim, type_id, "left")
    else:
        out = out.withColumn("__name", F.lit(None).cast("string"))
    return out.withColumn("domain_name", F.coalesce("__name", "__modal", F.lit(""))).drop("__name", "__modal")


def _distinct_count(df: DataFrame, by: str, col: str, name: str) -> DataFrame:
    """Two-step distinct count: a hot group spreads over its values."""
    return df.filter(~missing(col)).select(by, col).distinct().groupBy(by).agg(F.count(F.lit(1)).alias(name))


def support(df: DataFrame, entity: str, feature: str) -> DataFrame:
    return _distinct_count(df, feature, entity, "n_entities")


def cooccurrence(df: DataFrame, entity: str, feature: str, min_support: int = 1, block: int = 256) -> DataFrame:
    """Unordered pairs of distinct features on the same entity with their support."""
    distinct = df.select(entity, feature).distinct()
    pairs = co_members(distinct, entity, feature, block=block)
    counts = pairs.groupBy(F.col(f"a.{feature}").alias("domain_a"), F.col(f"b.{feature}").alias("domain_b")).agg(
        F.count(F.lit(1)).alias("protein_count")
    )
    return counts.filter(F.col("protein_count") >= min_support)


def order_pairs(
    df: DataFrame, entity: str, feature: str, order: Sequence[str], bucket: Column
) -> DataFrame:
    """Consecutive features along the entity: occurrence and entity support."""
    scanned = ordered_scan(df, [entity], bucket, list(order), __n=following(F.struct(F.col(feature).alias("f"))))
    pairs = scanned.filter("__n is not null").select(
        entity, F.col(feature).alias("first_type"), F.col("__n.f").alias("second_type")
    )
    per_entity = pairs.groupBy(entity, "first_type", "second_type").agg(F.count(F.lit(1)).alias("n"))
    return per_entity.groupBy("first_type", "second_type").agg(
        F.sum("n").alias("occurrence_support"), F.count(F.lit(1)).alias("protein_support")
    )


def chain_text(df: DataFrame, entity: str, feature: str, order: Sequence[str]) -> DataFrame:
    """``A > B > C`` along each entity."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(feature).alias("__f"))))
    return df.groupBy(entity).agg(F.array_join(F.transform(items, lambda x: x["__f"]), " > ").alias("chain"))


def build_types(entries: DataFrame, occ: DataFrame, type_id: str, cols: Sequence[str], position: str) -> DataFrame:
    """Type dimension: first entry row per id, blanks and absent ids filled from occurrences."""
    both = entries.select(type_id, *cols, F.col(position).alias("__p"), F.lit(0).alias("__s")).unionByName(
        occ.select(type_id, *cols, F.col(position).alias("__p"), F.lit(1).alias("__s"))
    )
    rank = F.struct("__s", "__p")
    aggs = [F.min_by(blank_to_null(c), F.when(~missing(c), rank)).alias(c) for c in cols]
    return both.filter(~missing(type_id)).groupBy(type_id).agg(*aggs)


def merge_types(df: DataFrame, type_id: str, cols: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One row per id: the greatest by (name, description, ...), ties to the smallest ``tie``."""
    rest = [c for c in df.columns if c not in (type_id,)]
    greatest = df.groupBy(type_id).agg(F.max(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in cols])).alias("__g"))
    same = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit("")) == F.col(f"__g.{c}") for c in cols])
    best = F.min(F.struct(*tie, *[c for c in rest if c not in tie])).alias("__r")
    return df.join(greatest, type_id).filter(same).groupBy(type_id).agg(best).select(type_id, *[f"__r.{c}" for c in rest])


def richness(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [(~missing(c)).cast("int") for c in columns])


def dedup_richest(df: DataFrame, key: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Keep the row with the most filled cells per key (aggregate, no window)."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct((-richness(df.columns)).alias("__neg"), *tie)
    row = F.struct(*rest)
    return df.groupBy(*key).agg(F.min_by(row, rank).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def duplicate_report(df: DataFrame, key: Sequence[str], by: str) -> DataFrame:
    """Rows that share their key with another row, counted per ``by`` value."""
    per = df.groupBy(*key, *([] if by in key else [by])).agg(F.count(F.lit(1)).alias("n"))
    keyed = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1")
    return per.join(keyed, list(key)).groupBy(by).agg(F.sum("n").alias("duplicate_rows"))


def dedup_first(df: DataFrame, key: Sequence[str], position: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*position)).alias("__r")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def dup_mask(df: DataFrame, key: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """Flag every member of a group of equal keys."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(counts, list(key)).withColumn(name, F.col("__n") > 1).drop("__n")


def protein_table(occ: DataFrame, entity: str, gene: str, groups: DataFrame, module: Column, position: str) -> DataFrame:
    """Entity dimension: first gene, number of domains, group, module."""
    base = occ.groupBy(entity).agg(
        F.min_by(blank_to_null(gene), F.when(~missing(gene), F.col(position))).alias("gene_symbol"),
        F.count(F.lit(1)).alias("n_domains"),
    )
    return base.join(groups, entity, "left").withColumn(
        "protein_group", F.coalesce("protein_group", F.lit("other"))
    ).withColumn("family_module", module)


def protein_summary(df: DataFrame, renames: dict[str, str], entity: str, position: str) -> DataFrame:
    out = df.filter(~missing(entity))
    first = dedup_first(out.select(entity, position, *[c for c in renames if c != entity]), [entity], [position])
    return first.drop(position).withColumnsRenamed(renames)


def features(df: DataFrame, entity: str, cols: dict[str, Column], binary: bool = False) -> DataFrame:
    """(entity, ``column::token``, n) from token columns."""
    cells = F.array(*[F.transform(toks, lambda t: F.concat(F.lit(f"{c}::"), t)) for c, toks in cols.items()])
    long = df.select(entity, F.explode(F.flatten(cells)).alias("feature"))
    counts = long.groupBy(entity, "feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n", F.lit(1).cast("long")) if binary else counts


def crosstab_top(df: DataFrame, row: str, col: str, rows: int = 40, cols: int = 30) -> DataFrame:
    """Long cross table trimmed to the largest rows, then to the largest columns of those."""
    counts = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    top_rows = counts.groupBy(row).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), row).limit(rows)
    kept = counts.join(top_rows, row, "left_semi")
    top_cols = kept.groupBy(col).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), col).limit(cols)
    return kept.join(top_cols, col, "left_semi").select(row, col, "n")


def diversity(df: DataFrame, by: str, target: str, k: int = 30) -> DataFrame:
    return _distinct_count(df, by, target, "n_targets").orderBy(F.desc("n_targets"), by).limit(k)


def token_frequency(df: DataFrame, tokens: Column, k: int = 30) -> DataFrame:
    return top_values(df.select(F.explode(tokens).alias("token")), "token", k)


def target_connectivity(df: DataFrame, tokens: Column, k: int = 30) -> DataFrame:
    """Occurrences per target, a target counted once per occurrence."""
    return top_values(df.select(F.explode(F.array_distinct(tokens)).alias("token")), "token", k)


def tagged_types(df: DataFrame, entity: str, type_id: str, tokens: Column, name: str) -> DataFrame:
    """Distinct (entity, type, token): which types carry which tag or target."""
    return df.select(entity, type_id, F.explode(tokens).alias(name)).distinct()


def type_pathway_support(df: DataFrame, entity: str, type_id: str, tokens: Column) -> DataFrame:
    """Entities per (pathway, type)."""
    distinct = df.select(entity, type_id, F.explode(tokens).alias("pathway")).distinct()
    return distinct.groupBy("pathway", type_id).agg(F.count(F.lit(1)).alias("protein_count"))


def token_distribution(df: DataFrame, tokens: Column, name: str) -> DataFrame:
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("count"))


def query_summary(named: dict[str, DataFrame]) -> DataFrame:
    """Rows and OK / EMPTY per named result."""
    parts = [
        q.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("query"), "n_rows") for n, q in named.items()
    ]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("status", F.when(F.col("n_rows") > 0, "OK").otherwise("EMPTY"))


def summary_metrics(df: DataFrame, distinct: Sequence[str], patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """(metric, value): rows, distinct values per column, distinct tokens matching a format."""
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows").alias("metric"), "value")]
    for c in distinct:
        parts.append(
            df.filter(~missing(c)).select(c).distinct().agg(F.count(F.lit(1)).alias("value"))
            .select(F.lit(f"distinct_{c}").alias("metric"), "value")
        )
    for name, (tokens, pattern) in patterns.items():
        parts.append(
            df.select(F.explode(tokens).alias("t")).filter(F.col("t").rlike(pattern)).distinct()
            .agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def network(df: DataFrame, entity: str, type_id: str, links: dict[str, tuple[str, Column]], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (first type wins, degree) and undirected edges (last type wins).

    links: node type -> (edge type, token array on the occurrence).
    """
    pos = F.struct(*order)
    base = df.select(
        pos.alias("p"), F.col(entity).cast("string").alias("__a"), F.col(type_id).alias("__b"),
        *[toks.alias(f"__l{i}") for i, (_, toks) in enumerate(links.values())],
    )
    edges = [base.select("p", F.lit(0).alias("k"), F.col("__a").alias("a"), F.col("__b").alias("b"), F.lit("has_domain").alias("edge_type"))]
    nodes = [
        base.select("p", F.lit(0).alias("k"), F.col("__a").alias("node"), F.lit("protein").alias("node_type")),
        base.select("p", F.lit(1).alias("k"), F.col("__b").alias("node"), F.lit("domain_type").alias("node_type")),
    ]
    for i, (node_type, (edge_type, _)) in enumerate(links.items()):
        part = base.select("p", "__b", F.explode(f"__l{i}").alias("t"))
        edges.append(part.select("p", F.lit(i + 1).alias("k"), F.col("__b").alias("a"), F.col("t").alias("b"), F.lit(edge_type).alias("edge_type")))
        nodes.append(part.select("p", F.lit(i + 2).alias("k"), F.col("t").alias("node"), F.lit(node_type).alias("node_type")))
    union = lambda dfs: reduce(lambda x, y: x.unionByName(y), dfs)
    edge_table = (
        union(edges).withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})
        .groupBy("u", "v").agg(F.max_by("edge_type", F.struct("p", "k")).alias("edge_type"))
    )
    node_table = union(nodes).groupBy("node").agg(F.min_by("node_type", F.struct("p", "k")).alias("node_type"))
    ends = edge_table.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return node_table.join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), edge_table
