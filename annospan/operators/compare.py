"""Comparison of two annotated tables and of pairs of their entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import missing
from annospan.operators.common import attach, union_all
from annospan.operators.summaries import top_k


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Array Jaccard; ``empty`` is the value when both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coeff(a: Column, b: Column, empty: float = 0.0) -> Column:
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(smaller == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def token_set(df: DataFrame, tokens: Column, lower: bool = True) -> DataFrame:
    token = F.lower("t") if lower else F.col("t")
    return df.select(F.explode(tokens).alias("t")).select(token.alias("token")).distinct()


def long_tokens(df: DataFrame, columns: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, category, token) over several token columns in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), toks.alias("t")) for k, toks in columns.items()])
    rows = df.select(*keys, F.explode(cells).alias("c"))
    return rows.select(*keys, F.col("c.k").alias("category"), F.explode("c.t").alias("token"))


def sided_tokens(a: DataFrame, b: DataFrame, columns: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, category, token, in_a, in_b, n_a, n_b): both tables in one aggregation."""
    both = long_tokens(a, columns, keys).withColumn("side", F.lit(0)).unionByName(
        long_tokens(b, columns, keys).withColumn("side", F.lit(1))
    )
    return both.groupBy(*keys, "category", "token").agg(
        F.sum((F.col("side") == 0).cast("long")).alias("n_a"), F.sum((F.col("side") == 1).cast("long")).alias("n_b")
    ).withColumns({"in_a": F.col("n_a") > 0, "in_b": F.col("n_b") > 0})


def overlap_metrics(a: DataFrame, b: DataFrame, columns: dict[str, Column], items: int = 10) -> DataFrame:
    """Sizes, shared, unique and Jaccard per category, with the first shared and unique tokens."""
    t = sided_tokens(a, b, columns)
    kind = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "only_a").otherwise("only_b")
    kinds = t.withColumn("kind", kind)
    sizes = kinds.groupBy("category").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("shared", "only_a", "only_b")]
    )
    first = top_k(kinds.select("category", "kind", "token"), ["category", "kind"], ["token"], items)
    lists = first.groupBy("category").agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("token")))), ";").alias(f"{k}_items")
        for k in ("shared", "only_a", "only_b")
    ])
    total = F.col("shared") + F.col("only_a") + F.col("only_b")
    every = a.sparkSession.createDataFrame([(k,) for k in columns], "category string")
    out = every.join(sizes, "category", "left").join(lists, "category", "left").fillna(0).fillna("")
    return out.select(
        "category",
        (F.col("shared") + F.col("only_a")).alias("size_a"),
        (F.col("shared") + F.col("only_b")).alias("size_b"),
        "shared", "only_a", "only_b",
        F.when(total == 0, 0.0).otherwise(F.round(F.col("shared") / total, 4)).alias("jaccard"),
        "shared_items", "only_a_items", "only_b_items",
    )


def schema_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of either table and where they occur (metadata only)."""
    names = sorted(set(a.columns) | set(b.columns))
    rows = [(c, c in a.columns, c in b.columns) for c in names]
    return a.sparkSession.createDataFrame(rows, "column_name string, in_a boolean, in_b boolean")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, filled, pct_filled, distinct) for several columns in one pass."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("c"), F.when(~missing(c), F.col(c).cast("string")).alias("v")) for c in columns
    ])
    values = df.select(F.explode(cells).alias("x")).select(F.col("x.c").alias("column_name"), F.col("x.v").alias("v"))
    per_value = values.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n_filled"),
        F.count("v").alias("n_distinct"),
    ).withColumn("pct_filled", F.round(F.col("n_filled") * 100.0 / F.col("n_rows"), 2))


def vocabulary_rate(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of distinct (category, token) that the vocabulary (category, token) knows."""
    distinct = tokens.select("category", "token").distinct()
    known = vocabulary.select("category", "token").distinct().withColumn("__k", F.lit(1))
    return distinct.join(known, ["category", "token"], "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count("__k").alias("n_backed"),
        F.round(F.count("__k") / F.count(F.lit(1)), 4).alias("backed_rate"),
    )


def transfer_metrics(a: DataFrame, b: DataFrame, columns: dict[str, Column], vocabulary: DataFrame) -> DataFrame:
    """(metric, value): conserved, new and unused terms; vocabulary reuse, mapping completeness."""
    t = sided_tokens(a, b, columns).select("category", "token", "in_a", "in_b")
    vocab = vocabulary.select("category", "token").distinct().withColumn("__v", F.lit(True))
    joined = t.join(vocab, ["category", "token"], "full").fillna(False, ["in_a", "in_b", "__v"])
    n = lambda cond: F.sum(cond.cast("long"))
    in_a, in_b, v = F.col("in_a"), F.col("in_b"), F.col("__v")
    sums = joined.agg(
        n(in_a & in_b).alias("conserved_terms"), n(in_b & ~in_a).alias("new_terms"), n(in_a & ~in_b).alias("unused_terms"),
        n(in_a & v).alias("ra"), n(in_a & in_b & v).alias("rb"), n(in_b).alias("tb"), n(in_b & v).alias("tv"),
    )
    ratio = lambda x, y: F.when(F.col(y) == 0, 0.0).otherwise(F.round(F.col(x) / F.col(y), 4))
    values = {
        "conserved_terms": F.col("conserved_terms").cast("double"),
        "new_terms": F.col("new_terms").cast("double"),
        "unused_terms": F.col("unused_terms").cast("double"),
        "vocabulary_reuse": ratio("rb", "ra"),
        "mapping_completeness": ratio("tv", "tb"),
        "species_specific_rate": ratio("new_terms", "tb"),
    }
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v_.alias("value")) for k, v_ in values.items()]))
    return sums.select(stack.alias("x")).select("x.*")


def schema_metrics(a: DataFrame, b: DataFrame, rule_columns: Sequence[str] = ()) -> DataFrame:
    """(metric, value): how much of the first table's columns and of the column rules the second one carries."""
    first, second = set(a.columns), set(b.columns)
    testable = sum(c in second for c in rule_columns)
    rows = {
        "schema_reuse_rate": round(len(first & second) / max(len(first), 1), 4),
        "n_shared_columns": len(first & second), "n_first_only_columns": len(first - second), "n_second_only_columns": len(second - first),
        "rule_portability_rate": round(testable / max(len(rule_columns), 1), 4),
        "n_testable_rules": testable, "n_total_rules": len(rule_columns),
    }
    return a.sparkSession.createDataFrame([(k, float(v)) for k, v in rows.items()], "metric string, value double")


def overlap_items(a: DataFrame, b: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(category, token, kind): every shared and one-sided token, one row each."""
    kind = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "only_a").otherwise("only_b")
    return sided_tokens(a, b, columns).select("category", "token", kind.alias("kind"))


def token_report(a: DataFrame, b: DataFrame, columns: dict[str, Column], vocabulary: DataFrame) -> DataFrame:
    """(metric, value_a, value_b, delta): distinct tokens and the share of token occurrences the vocabulary knows, per category."""
    known = vocabulary.select("category", "token").distinct().withColumn("__k", F.lit(1))

    def side(df: DataFrame, name: str) -> DataFrame:
        counted = long_tokens(df, columns).groupBy("category", "token").agg(F.count(F.lit(1)).alias("n")).join(known, ["category", "token"], "left")
        sums = counted.groupBy("category").agg(
            F.count(F.lit(1)).cast("double").alias("unique"),
            F.round(100 * F.sum(F.when(F.col("__k").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("backed"),
        )
        metric = lambda k, c: F.struct(F.concat(F.lit(k), F.col("category")).alias("metric"), F.col(c).alias("v"))
        both = F.explode(F.array(metric("unique_", "unique"), metric("backed_rate_", "backed")))
        return sums.select(both.alias("x")).select("x.metric", F.col("x.v").alias(name))

    joined = side(a, "value_a").join(side(b, "value_b"), "metric", "full").fillna(0.0)
    return joined.withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), 2))


def comparison_report(a: DataFrame, b: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(metric, value_a, value_b, delta) for aggregate expressions over both tables."""
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("v")) for k in measures]))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[m.alias(k) for k, m in measures.items()]).select(stack.alias("x")).select("x.metric", F.col("x.v").alias(name))

    joined = side(a, "value_a").join(side(b, "value_b"), "metric")
    return joined.withColumn("delta", F.round(F.col("value_b") - F.col("value_a"), 4))


def domain_conservation(a: DataFrame, b: DataFrame, token: str, shared: int = 8, unique: int = 6) -> DataFrame:
    """Most frequent shared and one-sided types with their occurrence counts."""
    t = sided_tokens(a, b, {"type": F.array(F.col(token).cast("string"))})
    kind = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "only_a").otherwise("only_b")
    ranked = t.select(kind.alias("kind"), F.col("token").alias("domain_type"), "n_a", "n_b").withColumn("neg", -(F.col("n_a") + F.col("n_b")))
    best = top_k(ranked.filter("kind = 'shared'"), ["kind"], ["neg", "domain_type"], shared)
    rest = top_k(ranked.filter("kind <> 'shared'"), ["kind"], ["neg", "domain_type"], unique)
    return best.unionByName(rest).drop("neg")


def tag_profile(a: DataFrame, b: DataFrame, tokens: Column, k: int = 15) -> DataFrame:
    """Token fractions per table, the ``k`` most frequent overall."""
    t = sided_tokens(a, b, {"tag": tokens}).select("token", "n_a", "n_b")
    sums = t.agg(F.sum("n_a").alias("sum_a"), F.sum("n_b").alias("sum_b"))
    frac = lambda n, s: F.round(F.col(n) / F.greatest(F.col(s), F.lit(1)), 4)
    best = t.orderBy(F.desc(F.col("n_a") + F.col("n_b")), "token").limit(k)
    return attach(best, sums).select("token", "n_a", "n_b", frac("n_a", "sum_a").alias("frac_a"), frac("n_b", "sum_b").alias("frac_b"))


def external_agreement(own: DataFrame, external: DataFrame, entity: str, sources: dict[str, Column]) -> DataFrame:
    """Per (entity, source): set sizes, overlap, Jaccard, overlap coefficient.

    ``sources`` maps a source to the token array both tables hold.
    """
    t = sided_tokens(own, external, sources, [entity])
    sizes = t.groupBy(entity, F.col("category").alias("source")).agg(
        F.sum(F.col("in_a").cast("long")).alias("n_own"), F.sum(F.col("in_b").cast("long")).alias("n_external"),
        F.sum((F.col("in_a") & F.col("in_b")).cast("long")).alias("n_shared"),
    )
    union = F.col("n_own") + F.col("n_external") - F.col("n_shared")
    smaller = F.least("n_own", "n_external")
    return sizes.withColumns({
        "jaccard": F.when(union == 0, 0.0).otherwise(F.round(F.col("n_shared") / union, 4)),
        "overlap_coefficient": F.when(smaller == 0, 0.0).otherwise(F.round(F.col("n_shared") / smaller, 4)),
    })


def agreement_summary(agreement: DataFrame) -> DataFrame:
    return agreement.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_proteins"),
        F.round(F.avg("jaccard"), 4).alias("mean_jaccard"),
        F.round(F.avg("overlap_coefficient"), 4).alias("mean_overlap"),
        F.sum("n_own").alias("sum_own"), F.sum("n_external").alias("sum_external"), F.sum("n_shared").alias("sum_shared"),
    )


def external_mapping(df: DataFrame, entity: str, columns: dict[str, Column]) -> DataFrame:
    """Sorted distinct identifiers per entity and source, one column per source."""
    distinct = long_tokens(df, columns, [entity]).distinct()
    return distinct.groupBy(entity).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("category") == k, F.col("token")))), ";").alias(k) for k in columns
    ])


def unpaired(left: DataFrame, right: DataFrame, pairs: DataFrame, entity: str, left_id: str, right_id: str) -> DataFrame:
    """Entities of either side without a pair (identifiers compared in upper case)."""
    def side(df: DataFrame, pid: str, name: str) -> DataFrame:
        ids = df.select(F.upper(F.trim(F.col(entity).cast("string"))).alias("accession")).distinct()
        paired = pairs.select(F.upper(F.trim(F.col(pid).cast("string"))).alias("accession"))
        return ids.join(paired, "accession", "left_anti").select(F.lit(name).alias("side"), "accession")

    return union_all([side(left, left_id, "left"), side(right, right_id, "right")])


def pair_conservation(
    a: DataFrame, b: DataFrame, pairs: DataFrame, entity: str, left_id: str, right_id: str, columns: dict[str, Column],
    shown: int = 8,
) -> DataFrame:
    """Per pair and category: sizes, Jaccard and the first shared tokens; long form.

    Tokens of the paired entities are joined, not collected: a crowded entity
    contributes one row per distinct token.
    """
    keys = pairs.select(left_id, right_id).distinct()
    ta = long_tokens(a, columns, [entity]).distinct().withColumnRenamed(entity, left_id)
    tb = long_tokens(b, columns, [entity]).distinct().withColumnRenamed(entity, right_id)
    both = (
        keys.join(ta, left_id).withColumn("side", F.lit(1))
        .unionByName(keys.join(tb, right_id).withColumn("side", F.lit(2)))
        .groupBy(left_id, right_id, "category", "token").agg(F.sum("side").alias("s"))
    )
    sizes = both.groupBy(left_id, right_id, "category").agg(
        F.sum((F.col("s") != 2).cast("long")).alias("n_a"), F.sum((F.col("s") != 1).cast("long")).alias("n_b"),
        F.sum((F.col("s") == 3).cast("long")).alias("n_shared"),
    )
    first = top_k(both.filter("s = 3").drop("s"), [left_id, right_id, "category"], ["token"], shown).groupBy(
        left_id, right_id, "category"
    ).agg(F.array_join(F.array_sort(F.collect_list("token")), ";").alias("shared_tokens"))
    grid = keys.withColumn("category", F.explode(F.array(*[F.lit(c) for c in columns])))
    out = grid.join(sizes, [left_id, right_id, "category"], "left").join(first, [left_id, right_id, "category"], "left").fillna(0).fillna("")
    union = F.col("n_a") + F.col("n_b") - F.col("n_shared")
    return out.withColumn("jaccard", F.when(union == 0, 0.0).otherwise(F.round(F.col("n_shared") / union, 4)))


def conservation_score(long: DataFrame, left_id: str, right_id: str, digits: int = 4) -> DataFrame:
    """Mean Jaccard per pair and whether every category is filled on both sides."""
    return long.groupBy(left_id, right_id).agg(
        F.round(F.avg("jaccard"), digits).alias("conservation_score"),
        F.min((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("complete"),
        F.sum(((F.col("n_a") > 0) & (F.col("n_b") > 0)).cast("long")).alias("n_comparable"),
    )
