"""Pairs of members that share a key, with hot keys cut into blocks.

A key with many members is cut into blocks of a bounded expected size; every
pair of blocks becomes its own group, so no task ever holds a whole hot key and
each pair of members meets exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.session import materialise

PLAIN_BLOCK = 1024  # members of a block that carries nothing else
TASK_PAIRS = 50_000_000  # pairs that a task makes, about


def block_groups(df: DataFrame, key: str, member: str, payload: list[str] = (), block: int = 256) -> DataFrame:
    """(key, lo, hi, left, right): two member arrays of one block pair.

    ``df`` holds distinct (key, member) rows. ``left`` is the only array when
    ``lo = hi``. Array elements are structs ``(member, *payload)``.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("__n"))
    rows = (
        df.join(sizes.filter("__n > 1"), key, "left")
        .withColumn("__n", F.coalesce("__n", F.lit(1)))
        .withColumn("__b", F.pmod(F.xxhash64(member), F.col("__n")).cast("int"))
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("lo", F.least("__b", "__o"))
        .withColumn("hi", F.greatest("__b", "__o"))
    )
    item = F.struct(F.col(member), *[F.col(p) for p in payload])
    return rows.groupBy(key, "lo", "hi").agg(
        F.collect_list(F.when(F.col("__b") == F.col("lo"), item)).alias("left"),
        F.collect_list(F.when((F.col("__b") == F.col("hi")) & (F.col("lo") < F.col("hi")), item)).alias("right"),
    )


def pairs_of_groups(groups: DataFrame, key: str, member: str) -> DataFrame:
    """(key, a, b) with ``a.member < b.member``, one row per pair of the groups."""
    partners = F.when(F.col("lo") == F.col("hi"), F.col("left")).otherwise(F.col("right"))
    one = groups.withColumn("__p", partners).withColumn("__x", F.explode("left"))
    both = one.withColumn("__y", F.explode("__p"))
    x, y = F.col("__x"), F.col("__y")
    inner = F.col("lo") == F.col("hi")
    swap = x[member] > y[member]
    return both.filter(~inner | (x[member] < y[member])).select(
        key,
        F.when(swap, y).otherwise(x).alias("a"),
        F.when(swap, x).otherwise(y).alias("b"),
    )


def co_members(df: DataFrame, key: str, member: str, payload: list[str] = (), block: int = 256) -> DataFrame:
    """Pairs of distinct members that share a key, ``a < b``, once per key."""
    return pairs_of_groups(block_groups(df, key, member, list(payload), block), key, member)


def member_pairs(df: DataFrame, key: str, member: str, block: int = PLAIN_BLOCK, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a, b): pairs ``a < b`` of members of a key, for results of all pairs that carry nothing else.

    Both sides of a pair of blocks meet in a sort merge join, which holds one block at a
    time. Pairs are far more than the rows that are shuffled, so their number decides how many
    tasks there are. Nulls are in no pair.
    """
    known = df.select(F.col(key).alias("__key"), F.col(member).alias("__m")).dropna()
    counts = known.groupBy("__key").agg(F.count(F.lit(1)).alias("__c")).withColumn("__k", F.monotonically_increasing_id())
    counts = materialise(counts, "counts")
    pairs = counts.agg(F.sum(F.col("__c").cast("double") * (F.col("__c") - 1) / 2).alias("p")).first().p or 0.0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(pairs // task_pairs) + 1)
    sizes = counts.select("__key", "__k", F.ceil(F.col("__c") / block).cast("int").alias("__n"))
    cut = known.join(sizes, "__key").select("__k", "__m", "__n", F.pmod(F.xxhash64("__m"), F.col("__n")).cast("int").alias("__b"))
    low, high = (F.sequence(F.col("__b"), F.col("__n") - 1), F.sequence(F.lit(0), F.col("__b")))
    left = cut.select("__k", F.col("__b").alias("__lo"), F.explode(low).alias("__hi"), F.col("__m").alias("__x"))
    right = cut.select("__k", F.explode(high).alias("__lo"), F.col("__b").alias("__hi"), F.col("__m").alias("__y"))
    at = ["__lo", "__hi", "__k"]
    met = left.repartition(tasks, *at).hint("merge").join(right.repartition(tasks, *at), at)
    met = met.filter((F.col("__lo") < F.col("__hi")) | (F.col("__x") < F.col("__y")))
    return met.select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"))


def token_sets(df: DataFrame, entity: str, token: str) -> DataFrame:
    """(signature, tokens, n_tokens, n_entities, ...) : entities with equal sets collapsed.

    Returns the map entity -> signature and the distinct signatures.
    """
    distinct = df.select(entity, token).distinct()
    sets = distinct.groupBy(entity).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return sets.withColumn("signature", F.md5(F.to_json("tokens")))


def _min_overlap(measure: str, threshold: float, size: Column) -> Column:
    """Smallest overlap with any partner that can still reach the threshold."""
    if measure == "jaccard":
        bound = F.lit(threshold) * size
    else:  # dice: 2o / (a + b) >= t with o <= b  =>  o >= t * a / (2 - t)
        bound = F.lit(threshold / (2.0 - threshold)) * size
    return F.greatest(F.ceil(bound - F.lit(1e-9)).cast("int"), F.lit(1))


def _ranked_token(freq: Column, token: Column) -> Column:
    """Token as text that sorts by frequency first (text keeps array intersections hashed)."""
    return F.concat(F.lpad(freq.cast("string"), 19, "0"), F.lit("|"), token.cast("string"))


def similar_sets(
    sets: DataFrame,
    id_col: str,
    tokens_col: str,
    threshold: float,
    measure: str = "jaccard",
    block: int = 256,
) -> DataFrame:
    """All pairs of sets whose similarity reaches ``threshold`` (exact).

    Prefix filter: with tokens ordered rarest first, two sets that overlap in
    ``o`` tokens share one inside their first ``n - o + 1`` tokens. Only those
    tokens become join keys, each pair is kept at its first common prefix token
    only, and hot tokens are cut into blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    exploded = sets.select(id_col, F.explode(tokens_col).alias("__t"))
    freq = exploded.groupBy("__t").agg(F.count(F.lit(1)).alias("__f"))
    ranked = (
        exploded.join(freq, "__t")
        .groupBy(id_col)
        .agg(F.array_sort(F.collect_list(_ranked_token(F.col("__f"), F.col("__t")))).alias("__r"))
        .withColumn("__size", F.size("__r"))
        .withColumn("__plen", F.col("__size") - _min_overlap(measure, threshold, F.col("__size")) + 1)
        .withColumn("__prefix", F.slice("__r", 1, F.col("__plen")))
    )
    members = ranked.select(
        F.explode("__prefix").alias("__key"), id_col, F.col("__r").alias("toks"), F.col("__prefix").alias("pre")
    )
    pairs = co_members(members, "__key", id_col, ["toks", "pre"], block)
    inter = F.size(F.array_intersect("a.toks", "b.toks"))
    na, nb = F.size("a.toks"), F.size("b.toks")
    first_common = F.array_min(F.array_intersect("a.pre", "b.pre")) == F.col("__key")
    if measure == "jaccard":
        sim = inter / (na + nb - inter)
    else:
        sim = 2 * inter / (na + nb)
    ratio = threshold if measure == "jaccard" else threshold / (2.0 - threshold)
    sizes_fit = (na >= nb * ratio - 1e-9) & (nb >= na * ratio - 1e-9)
    return (
        pairs.filter(sizes_fit).filter(first_common)
        .select(
            F.col(f"a.{id_col}").alias("a"),
            F.col(f"b.{id_col}").alias("b"),
            inter.alias("shared"),
            na.alias("n_a"),
            nb.alias("n_b"),
            sim.alias("similarity"),
        )
        .filter(F.col("similarity") >= threshold - 1e-12)
    )


def prefix_candidates(
    left: DataFrame, left_id: str, left_tokens: str, right: DataFrame, right_id: str, right_tokens: str, threshold: float
) -> DataFrame:
    """(left_id, right_id) pairs of two tables that can reach a Dice ``threshold``.

    Same prefix filter as ``similar_sets`` for a join of two sides; every pair
    that reaches the threshold is in the result, each pair once.
    """
    freq = (
        left.select(F.explode(left_tokens).alias("k")).unionByName(right.select(F.explode(right_tokens).alias("k")))
        .groupBy("k").agg(F.count(F.lit(1)).alias("f"))
    )

    def prefix(df: DataFrame, key: str, tokens: str, name: str) -> DataFrame:
        ranked = (
            df.select(key, F.explode(tokens).alias("k")).join(freq, "k")
            .groupBy(key).agg(F.array_sort(F.collect_list(_ranked_token(F.col("f"), F.col("k")))).alias("r"))
        )
        size = F.size("r")
        cut = ranked.withColumn(name, F.slice("r", 1, size - _min_overlap("dice", threshold, size) + 1))
        return cut.select(key, name, F.explode(name).alias("k"))

    both = prefix(left, left_id, left_tokens, "__pl").join(prefix(right, right_id, right_tokens, "__pr"), "k")
    return both.filter(F.array_min(F.array_intersect("__pl", "__pr")) == F.col("k")).select(left_id, right_id)
