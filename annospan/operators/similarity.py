"""Similarity, ordination, clustering and agreement of entities described by token sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, ShortType, StructField, StructType

from annospan.functions.digests import digest_order, text_array
from annospan.functions.stats import normal_sf
from annospan.operators import tiles
from annospan.operators.blocks import PLAIN_BLOCK, co_members, member_pairs, similar_sets, token_sets
from annospan.operators.common import attach, product
from annospan.operators.ordered import draw_hash, hash_bucket, ordered_scan, row_number, running_sum, with_iterations
from annospan.operators.summaries import modal
from annospan.session import materialise


RANK_BUCKETS = 256
FULL_IDS = 2048  # a square of so many doubles is 32 MB
DENSE_IDS = 8192  # and of so many 512 MB
DENSE_PAIRS = 20_000_000
PAIRS_AT_ONCE = 500_000
CHUNK_CELLS = 20_000_000  # of a chunk of rows that a task holds
HELD_CELLS = 1_000_000  # numbers of the rows that are laid out at a time (8 MB)
DENSE_ENTITIES = 12_000_000  # some 50 bytes each in a task


def pairwise_jaccard(features: DataFrame, entity: str, feature: str, block: int = 256) -> DataFrame:
    """Jaccard of all entity pairs that share a feature; all other pairs are zero.

    Meant for dimension-sized entity sets; use ``similar_pairs`` with a
    threshold where entities number in the millions.
    """
    distinct = features.select(entity, feature).distinct()
    sizes = distinct.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    shared = (
        co_members(distinct, feature, entity, block=block)
        .groupBy(F.col(f"a.{entity}").alias("a"), F.col(f"b.{entity}").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        shared.join(sizes.select(F.col(entity).alias("a"), F.col("n").alias("n_a")), "a")
        .join(sizes.select(F.col(entity).alias("b"), F.col("n").alias("n_b")), "b")
        .withColumn("similarity", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))
    )


def _equal_pairs(members: DataFrame, sizes: DataFrame, entity: str, block: int) -> DataFrame:
    """(__x, __y, shared, similarity) of members with the same signature."""
    return co_members(members, "signature", entity, block=block).join(sizes, "signature").select(
        F.col(f"a.{entity}").alias("__x"), F.col(f"b.{entity}").alias("__y"), "shared", F.lit(1.0).alias("similarity")
    )


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"), "shared", "similarity")


def _pairs_of_sets(members: DataFrame, distinct: DataFrame, entity: str, min_sim: float, block: int) -> DataFrame:
    """Pairs of members whose (distinct) sets reach ``min_sim``, equal sets included."""
    sizes = distinct.select("signature", F.size("tokens").alias("shared"))
    equal = _equal_pairs(members, sizes, entity, block)
    if min_sim >= 1:
        return _ordered_pairs(equal)
    across = similar_sets(distinct, "signature", "tokens", min_sim, block=block)
    left = members.select(F.col(entity).alias("__x"), F.col("signature").alias("a"))
    right = members.select(F.col(entity).alias("__y"), F.col("signature").alias("b"))
    mixed = across.join(left, "a").join(right, "b").select("__x", "__y", "shared", "similarity")
    return _ordered_pairs(mixed.unionByName(equal))


def similar_pairs(features: DataFrame, entity: str, feature: str, min_sim: float = 0.3, block: int = 256) -> DataFrame:
    """Entity pairs whose Jaccard reaches ``min_sim`` (exact, prefix filtered).

    Entities with equal sets are collapsed first; the similarity join runs on
    distinct sets and the copies are paired afterwards.
    """
    sets = token_sets(features, entity, feature)
    distinct = sets.groupBy("signature").agg(F.first("tokens").alias("tokens"))
    return _pairs_of_sets(sets.select(entity, "signature"), distinct, entity, min_sim, block)


def best_pairs(features: DataFrame, entity: str, feature: str, n: int, min_sim: float, block: int = 256, steps: Sequence[float] = (1.0, 0.8, 0.6)) -> DataFrame:
    """The ``n`` most similar pairs with at least ``min_sim``, ties to the smaller ids.

    Of entities with equal sets only the ``n + 1`` smallest can be in the answer.
    The threshold is lowered step by step until ``n`` pairs reach it: all better
    pairs are then known, and the weak pairs are never formed.
    """
    sets = materialise(token_sets(features, entity, feature), "token-sets")
    order = F.row_number().over(Window.partitionBy("signature").orderBy(entity))
    members = sets.select(entity, "signature").withColumn("__n", order).filter(F.col("__n") <= n + 1).drop("__n")
    distinct = sets.groupBy("signature").agg(F.first("tokens").alias("tokens"))
    for step in [*(s for s in steps if s > min_sim), min_sim]:
        best = materialise(_pairs_of_sets(members, distinct, entity, step, block).orderBy(F.desc("similarity"), "a", "b").limit(n), "best-pairs")
        if step == min_sim or best.count() == n:
            return best
    raise ValueError("min_sim must be a number")


def top_pairs(
    features: DataFrame, entity: str, feature: str, labels: DataFrame | None = None, label: str = "cluster",
    n: int = 50, min_sim: float = 0.3, shown: int = 5, width: int = 25,
) -> DataFrame:
    """The ``n`` most similar pairs with their shared features and a same-label flag."""
    best = best_pairs(features, entity, feature, n, min_sim)
    distinct = features.select(entity, feature).distinct()
    fa = best.select("a", "b").join(distinct.withColumnsRenamed({entity: "a", feature: "f"}), "a")
    both = fa.join(distinct.withColumnsRenamed({entity: "b", feature: "f"}), ["b", "f"])
    text = both.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.substring("f", 1, width))).alias("__f")).select(
        "a", "b", F.array_join(F.slice("__f", 1, shown), ";").alias("top_shared_features")
    )
    out = best.join(text, ["a", "b"], "left")
    if labels is not None:
        la = labels.select(F.col(entity).alias("a"), F.col(label).alias("label_a"))
        lb = labels.select(F.col(entity).alias("b"), F.col(label).alias("label_b"))
        out = out.join(la, "a", "left").join(lb, "b", "left").withColumn("same_cluster", F.col("label_a") == F.col("label_b"))
    return out


def cluster_distance(clusters: DataFrame, entity: str, cluster: str, block: int = PLAIN_BLOCK) -> DataFrame:
    """The pairs at distance 0 (same cluster); every absent pair is at distance 1. Nulls are in no cluster."""
    return member_pairs(clusters, cluster, entity, block).select("a", "b", F.lit(0).alias("distance"))


def group_matrix(features: DataFrame, groups: DataFrame, entity: str, feature: str, group: str, block: int | None = None) -> DataFrame:
    """(group_a <= group_b, sum_similarity, n_pairs, mean_similarity) over all entity pairs.

    Entities with equal sets count once with their multiplicity; the sums are made
    in tiles of pairs of set blocks.
    """
    sets, names = tiles.marked_sets(token_sets(features, entity, feature), groups, entity, group)
    sizes = sets.select(F.explode("marks").alias("k")).groupBy(F.col("k.label").alias("code")).agg(F.sum("k.m").cast("long").alias("n")).join(names, "code")
    side = lambda c: names.select(F.col("code").alias(c), F.col(group).alias(f"__{c}"))
    sums = tiles.group_sums(sets, block).join(side("x"), "x").join(side("y"), "y").select(
        F.least("__x", "__y").alias("group_a"), F.greatest("__x", "__y").alias("group_b"), F.col("total").alias("sum_similarity")
    )
    grid = product(
        sizes.select(F.col(group).alias("group_a"), F.col("n").alias("na")),
        sizes.select(F.col(group).alias("group_b"), F.col("n").alias("nb")),
    ).filter("group_a <= group_b")
    n_pairs = F.when(F.col("group_a") == F.col("group_b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    out = grid.withColumn("n_pairs", n_pairs.cast("long")).join(sums, ["group_a", "group_b"], "left").fillna(0.0, ["sum_similarity"])
    return out.select(
        "group_a", "group_b", "n_pairs", "sum_similarity",
        F.when(F.col("n_pairs") > 0, F.col("sum_similarity") / F.col("n_pairs")).alias("mean_similarity"),
    )


def group_similarity(matrix: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """Within and between mean per group and their ratio, from the group matrix."""
    ends = matrix.select(F.explode(F.array_distinct(F.array("group_a", "group_b"))).alias(group), "group_a", "group_b", "n_pairs", "sum_similarity")
    inside = F.col("group_a") == F.col("group_b")
    stats = ends.groupBy(group).agg(
        F.sum(F.when(inside, F.col("sum_similarity"))).alias("ws"), F.sum(F.when(inside, F.col("n_pairs"))).alias("wn"),
        F.sum(F.when(~inside, F.col("sum_similarity"))).alias("bs"), F.sum(F.when(~inside, F.col("n_pairs"))).alias("bn"),
    )
    within = F.when(F.col("wn") > 0, F.round(F.col("ws") / F.col("wn"), 4)).otherwise(0.0)
    between = F.when(F.col("bn") > 0, F.round(F.col("bs") / F.col("bn"), 4)).otherwise(0.0)
    return stats.join(sizes, group).select(
        group, "n_proteins", within.alias("within_mean_sim"), between.alias("between_mean_sim"),
        F.round(within / (between + 1e-9), 4).alias("separation_ratio"),
    )


def cluster_matrix(matrix: DataFrame, labels: DataFrame, entity: str, cluster: str, group: str) -> DataFrame:
    """Mean similarity between clusters with the dominant group of each."""
    dom = modal(labels, [cluster], group, "dominant")
    return matrix.join(
        dom.select(F.col(cluster).alias("group_a"), F.col("dominant").alias("dominant_a")), "group_a"
    ).join(dom.select(F.col(cluster).alias("group_b"), F.col("dominant").alias("dominant_b")), "group_b")


def silhouette(features: DataFrame, labels: DataFrame, entity: str, feature: str, label: str, block: int | None = None) -> DataFrame:
    """Exact mean silhouette (Euclidean distance of binary features), one row; distances are summed in tiles."""
    sets, _ = tiles.marked_sets(token_sets(features, entity, feature), labels, entity, label)
    return tiles.silhouette_of(sets, tiles.distance_sums(sets, block))


def avg_rank(df: DataFrame, value: str, bucket: Column, by: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Rank of each value with ties averaged, from counts of distinct values."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    scanned = ordered_scan(counts, by, bucket, [value], __before=running_sum(F.col("__c"), exclusive=True))
    ranks = scanned.select(*by, value, (F.col("__before") + (F.col("__c") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])


def mann_whitney(df: DataFrame, value: str, is_x: Column, bucket: Column) -> DataFrame:
    """One-sided U test that x exceeds y: normal approximation with tie and continuity correction."""
    counts = df.groupBy(value).agg(F.sum(is_x.cast("long")).alias("nx"), F.sum((~is_x).cast("long")).alias("ny"))
    counts = counts.withColumn("c", F.col("nx") + F.col("ny"))
    scanned = ordered_scan(counts, [], bucket, [value], before=running_sum(F.col("c"), exclusive=True))
    rank = F.col("before") + (F.col("c") + 1) / 2.0
    sums = scanned.agg(
        F.sum(rank * F.col("nx")).alias("rx"), F.sum("nx").alias("n_x"), F.sum("ny").alias("n_y"),
        F.sum(F.pow(F.col("c").cast("double"), F.lit(3)) - F.col("c")).alias("ties"),
    )
    nx, ny = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    u = F.col("rx") - nx * (nx + 1) / 2
    n = nx + ny
    sigma = F.sqrt(nx * ny / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - nx * ny / 2 - 0.5) / sigma
    return sums.select(u.alias("u"), "n_x", "n_y", z.alias("z"), normal_sf(z).alias("p_value"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, null when one side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


def _shifted(pairs: DataFrame, name: str, method: str, total: Column, absent: float) -> DataFrame:
    """(a, b, name): each distance, or its rank, minus the value that all absent pairs share.

    Absent pairs are one block of ties at distance ``absent``, the largest of all;
    its size is the number of all pairs minus those of the table. The bucket of
    the rank scan is the leading part of the distance, so no task ranks them all.
    """
    if method != "spearman":
        return pairs.select("a", "b", (F.col("distance") - absent).alias(name))
    counts = pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("__c"))
    scanned = ordered_scan(counts, [], F.floor(F.col("distance") * (RANK_BUCKETS / absent)), ["distance"], __before=running_sum(F.col("__c"), exclusive=True))
    nearer = pairs.filter(F.col("distance") < absent).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    # the block of ties starts behind all nearer pairs and ends with the last pair
    block = nearer + (total - nearer + 1) / 2.0
    own = F.when(F.col("distance") < absent, F.col("__before") + (F.col("__c") + 1) / 2.0).otherwise(block)
    ranks = scanned.select("distance", (own - block).alias(name))
    return pairs.join(ranks, "distance").select("a", "b", name)


def _complete_r(su: Column, suu: Column, sv: Column, svv: Column, suv: Column, m: Column) -> Column:
    """Correlation over ``m`` pairs from sums over those that differ from the common value."""
    spread = F.sqrt((m * suu - su * su) * (m * svv - sv * sv))
    return F.try_divide(m * suv - su * sv, F.when(spread > 0, spread))


def over_iterations(spark, n: int, of: Callable[[int], float], name: str) -> DataFrame:
    """(iteration, name) for iterations 1..n, in a few batches per core."""
    rows = spark.range(1, n + 1, 1, min(n, 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            its = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(its, pa.int32()), pa.array([float(of(i)) for i in its])], names=["iteration", name])

    return rows.mapInArrow(run, f"iteration int, {name} double")


def _numbered_ids(ids: DataFrame, kind) -> tuple[DataFrame, int, tuple[np.ndarray, np.ndarray]]:
    """(id, at) in the order of the texts that name ids in digests, their number and the texts."""
    named = ids.select("id", F.concat_ws("|", F.col("id").cast("string"), F.col("id").cast("string")).alias("t")).distinct().orderBy("t").toArrow()
    schema = StructType([StructField("id", ids.schema["id"].dataType), StructField("at", kind)])
    place = ids.sparkSession.createDataFrame([(x, i) for i, x in enumerate(named.column("id").to_pylist())], schema)
    return place, named.num_rows, text_array(named.column("t"))


def _cells_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Concatenated ranges first..last (exclusive)."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _rows_held(packets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, end, column, value) of packets (at, cells), by row."""
    order = np.argsort(packets.column("at").to_numpy())
    cells = packets.column("cells").combine_chunks()
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    cells = cells.take(pa.array(order))
    flat = cells.flatten()
    return packets.column("at").to_numpy()[order], np.cumsum(cells.value_lengths().to_numpy(), dtype="i8"), flat.field("to").to_numpy(), flat.field("s").to_numpy()


def _joined_products(u: DataFrame, v: DataFrame, ids: DataFrame, n: int, seed: int) -> DataFrame:
    """(iteration, suv): cross products under permuted ids, from chunks of rows of both sides that meet in tasks.

    A task holds a chunk of rows of the pairs of ``u`` and one of the rows of ``v`` (of ``CHUNK_CELLS`` cells, about) and evaluates
    its share of all iterations: of the first chunk's rows those that an iteration sends into the second. So no row is made per
    iteration and pair, and what is shuffled grows with the pairs times the chunks.
    """
    place, k, texts = _numbered_ids(ids, IntegerType())
    sizes = [x.count() for x in (u, v)]
    chunks = max(1, -(-max(sizes[0], 2 * sizes[1]) // CHUNK_CELLS))
    shares = min(n, max(1, -(-u.sparkSession.sparkContext.defaultParallelism // chunks**2)))
    width = -(-max(k, 1) // chunks)

    def packets(pairs: DataFrame, name: str, both: bool) -> DataFrame:
        side = lambda c: place.withColumnsRenamed({"id": c, "at": f"at_{c}"})
        rows = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("at_a").alias("at"), F.col("at_b").alias("to"), F.col(name).cast("double").alias("s"))
        rows = rows.unionByName(rows.select(F.col("to").alias("at"), F.col("at").alias("to"), "s")) if both else rows
        return materialise(rows.groupBy("at").agg(F.collect_list(F.struct("to", "s")).alias("cells")), "packets")

    every = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    own = F.floor(F.col("at") / width).cast("int")
    left = packets(u, "u", False).select(own.alias("i"), "at", "cells", every("j", chunks)).select("*", every("share", shares))
    right = packets(v, "v", True).select(own.alias("j"), "at", "cells", every("i", chunks)).select("*", every("share", shares))
    held = u.sparkSession.sparkContext.broadcast((texts, digest_order(f"{seed}|fixed|", *texts)))

    def met(key: tuple, first: pa.Table, second: pa.Table) -> pa.Table:
        iterations = np.arange(1 + key[2].as_py(), n + 1, shares, dtype="i4")
        total = np.zeros(len(iterations))
        if first.num_rows and second.num_rows:
            texts, fixed = held.value
            (row, end, column, weight), (there, stop, to_column, value) = _rows_held(first), _rows_held(second)
            begin, start = end - np.diff(end, prepend=0), stop - np.diff(stop, prepend=0)
            found = np.full(k, -1, "i8")
            found[there] = np.arange(len(there))
            step = max(1, HELD_CELLS // k)
            laid, to = np.zeros(step * k), np.empty(k, "i4")
            for x, iteration in enumerate(iterations):
                to[fixed] = digest_order(f"{seed}|{iteration}|", *texts)
                reached = found[to[row]]
                rows = np.flatnonzero(reached >= 0)
                for low in range(0, len(rows), step):
                    part = rows[low : low + step]
                    other, base = reached[part], np.arange(len(part)) * k
                    cells = _cells_of(start[other], stop[other])
                    at = to_column[cells] + np.repeat(base, stop[other] - start[other])
                    laid[at] = value[cells]
                    cells = _cells_of(begin[part], end[part])
                    total[x] += weight[cells] @ laid[to[column[cells]] + np.repeat(base, end[part] - begin[part])]
                    laid[at] = 0.0
        return pa.table({"iteration": iterations, "suv": total})

    keys = ["i", "j", "share"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, "iteration int, suv double")
    return parts.groupBy("iteration").agg(F.sum("suv").alias("suv"))


def _permuted_products(u: DataFrame, v: DataFrame, ids: DataFrame, n: int, seed: int) -> DataFrame:
    """The same from at most ``DENSE_IDS`` ids: the pairs and a square of the second side are held by each task."""
    place, k, texts = _numbered_ids(ids, ShortType())

    def numbered(pairs: DataFrame, name: str) -> tuple[np.ndarray, ...]:
        side = lambda c: F.broadcast(place.withColumnsRenamed({"id": c, "at": f"at_{c}"}))
        rows = pairs.join(side("a"), "a").join(side("b"), "b").select("at_a", "at_b", F.col(name).cast("double").alias(name)).toArrow()
        a, b, value = (rows.column(c).to_numpy() for c in ("at_a", "at_b", name))
        order = np.argsort(a, kind="stable")  # neighbours meet the same row of the square
        return a[order], b[order], value[order]

    held = u.sparkSession.sparkContext.broadcast((numbered(u, "u"), numbered(v, "v"), texts, digest_order(f"{seed}|fixed|", *texts)))
    ready = []

    def prepare() -> tuple:
        (a, b, weight), (x, y, value), texts, fixed = held.value
        square = np.zeros((k, k))
        square[x, y] = value
        square[y, x] = value
        if k <= FULL_IDS and len(weight) * 8 > k * k:  # of many pairs whole rows are moved, which is faster than pair by pair
            weights = np.zeros((k, k))
            weights[a, b] = weight
            a, b, weight = None, None, weights.ravel()
        return a, b, weight, square, texts, fixed

    def product(iteration: int) -> float:
        if not ready:
            ready.append(prepare())  # once a task
        a, b, weight, square, texts, fixed = ready[0]
        to = np.empty(k, dtype=np.int32)
        to[fixed] = digest_order(f"{seed}|{iteration}|", *texts)
        if a is None:
            return float(weight @ square[to][:, to].ravel())
        cells, row, total = square.ravel(), to * np.int32(k), 0.0
        for low in range(0, len(a), PAIRS_AT_ONCE):
            part = slice(low, low + PAIRS_AT_ONCE)
            total += float(weight[part] @ cells.take(row.take(a[part]) + to.take(b[part])))
        return total

    return over_iterations(u.sparkSession, n, product, "suv")


def mantel(
    x: DataFrame, y: DataFrame, ids: DataFrame, n: int = 9999, method: str = "spearman", seed: int = 42, absent: float = 1.0
) -> DataFrame:
    """Mantel test of two distance tables over all pairs of ``ids`` (column id), two-tailed with +1.

    ``x`` and ``y`` hold (a < b, distance) of the pairs nearer than ``absent``; all
    other pairs are at that distance and enter in closed form: values are shifted
    so that theirs is zero, hence sums over the table are sums over all pairs and
    an inner join gives the cross products. Ranks do not change under permutation,
    so they are computed once; each iteration renames the ids of the second table.
    Up to ``DENSE_IDS`` ids and ``DENSE_PAIRS`` pairs a task evaluates many permutations over the whole tables,
    beyond that it does so for a chunk of rows of each; both draw the same permutations.
    """
    count = ids.select("id").distinct().agg(F.count(F.lit(1)).cast("double").alias("k"))
    total = count.select((F.col("k") * (F.col("k") - 1) / 2).alias("m")).select("m").scalar()
    # Distances are written first: ranking reads them several times.
    x, y = (materialise(pairs.select("a", "b", "distance"), "mantel-pairs") for pairs in (x, y))
    u = materialise(_shifted(x, "u", method, total, absent), "mantel-x")
    v = materialise(_shifted(y, "v", method, total, absent), "mantel-y")
    sums = attach(
        u.agg(F.coalesce(F.sum("u"), F.lit(0.0)).alias("su"), F.coalesce(F.sum(F.col("u") * F.col("u")), F.lit(0.0)).alias("suu")),
        v.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("sv"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("svv")),
    ).withColumn("m", total)
    r = _complete_r(*[F.col(c) for c in ("su", "suu", "sv", "svv", "suv", "m")])
    seen = u.join(v, ["a", "b"]).agg(F.coalesce(F.sum(F.col("u") * F.col("v")), F.lit(0.0)).alias("suv"))
    observed = attach(seen, sums).select(r.alias("r"), F.col("m").cast("long").alias("n_pairs"))
    few = ids.select("id").distinct().limit(DENSE_IDS + 1).count() <= DENSE_IDS and max(u.count(), v.count()) <= DENSE_PAIRS
    moved = (_permuted_products if few else _joined_products)(u, v, ids, n, seed)
    every = u.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("iteration"))
    null = attach(every.join(moved, "iteration", "left").withColumn("suv", F.coalesce("suv", F.lit(0.0))), sums).select("iteration", r.alias("r"))
    return _mantel_result(null, observed, n)


def _mantel_result(null: DataFrame, observed: DataFrame, n: int) -> DataFrame:
    obs = observed.select("r").scalar()
    stats = null.agg(
        F.sum((F.abs("r") >= F.abs(obs)).cast("long")).alias("__b"), F.avg("r").alias("null_mean"), F.stddev_pop("r").alias("null_std")
    )
    return attach(stats, observed).select(
        "r", ((F.col("__b") + 1) / F.lit(n + 1)).alias("p_value"), "null_mean", "null_std", "n_pairs"
    )


def _same_pair_corr(counts: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation over all pairs of 'same a' with 'same b', from a contingency table."""
    choose = lambda c: c * (c - 1) / 2.0
    cell = counts.groupBy(*by).agg(F.sum(choose(F.col("n"))).alias("s11"), F.sum("n").alias("total"))
    rows = counts.groupBy(*by, a).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(choose(F.col("n"))).alias("s1"))
    cols = counts.groupBy(*by, b).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(choose(F.col("n"))).alias("s2"))
    t = cell.join(rows, list(by)).join(cols, list(by)) if by else attach(attach(cell, rows), cols)
    m = choose(F.col("total").cast("double"))
    s11, s1, s2 = F.col("s11"), F.col("s1"), F.col("s2")
    r = (m * s11 - s1 * s2) / F.sqrt(s1 * (m - s1) * s2 * (m - s2))
    return t.select(*by, r.alias("r"), m.cast("long").alias("n_pairs"))


def mantel_membership(df: DataFrame, entity: str, a: str, b: str, n: int = 9999, seed: int = 42) -> DataFrame:
    """Mantel test of two memberships (distance 0 inside a cluster, else 1).

    The correlation over all pairs follows from the contingency table, so an
    iteration costs one number per entity instead of one per pair. Up to
    ``DENSE_ENTITIES`` entities a task evaluates many permutations.
    """
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    observed = _same_pair_corr(cells, [], a, b)
    few = df.limit(DENSE_ENTITIES + 1).count() <= DENSE_ENTITIES
    null = (_permuted_memberships if few else _joined_memberships)(df, entity, a, b, n, seed)
    return _mantel_result(null, observed, n)


def _joined_memberships(df: DataFrame, entity: str, a: str, b: str, n: int, seed: int) -> DataFrame:
    """(iteration, r) by numbering both sides of every iteration, a row per iteration and entity."""
    tagged = df.select(
        F.struct(F.col(entity).alias("e"), F.col(a).alias("v")).alias("l"), F.struct(F.col(entity).alias("e"), F.col(b).alias("v")).alias("r")
    )
    copies = with_iterations(tagged, n)
    fixed = ordered_scan(
        copies.select("iteration", F.col("l.v").alias(a), F.concat(draw_hash(F.lit(seed), F.lit("fixed"), F.col("l.e")), F.col("l.e").cast("string")).alias("h")),
        ["iteration"], hash_bucket("h"), ["h"], k=row_number(),
    )
    mixed = ordered_scan(
        copies.select("iteration", F.col("r.v").alias(b), F.concat(draw_hash(F.lit(seed), F.col("iteration"), F.col("r.e")), F.col("r.e").cast("string")).alias("h")),
        ["iteration"], hash_bucket("h"), ["h"], k=row_number(),
    )
    counts = fixed.drop("h").join(mixed.drop("h"), ["iteration", "k"]).groupBy("iteration", a, b).agg(F.count(F.lit(1)).alias("n"))
    return _same_pair_corr(counts, ["iteration"], a, b).drop("n_pairs")


def _permuted_memberships(df: DataFrame, entity: str, a: str, b: str, n: int, seed: int) -> DataFrame:
    """The same from at most ``DENSE_ENTITIES`` entities, whose two labels each task holds as numbers."""
    rows = df.select(F.col(entity).cast("string").alias("e"), a, b).orderBy("e", a, b).toArrow()
    texts = text_array(rows.column("e"))
    codes = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (a, b)]
    width = int(codes[1].max(initial=0)) + 1
    cells = (int(codes[0].max(initial=0)) + 1) * width
    small = np.int32 if cells < 2**31 else np.int64
    held = df.sparkSession.sparkContext.broadcast((texts, codes[0][digest_order(f"{seed}|fixed|", *texts)].astype(small) * small(width), codes[1]))
    choose = lambda c: float((c * (c - 1)).sum()) / 2
    size = rows.num_rows
    s1, s2, m = choose(np.bincount(codes[0])), choose(np.bincount(codes[1])), size * (size - 1) / 2
    spread = (s1 * (m - s1) * s2 * (m - s2)) ** 0.5

    def correlation_of(iteration: int) -> float:
        texts, first, second = held.value
        met = first + second[digest_order(f"{seed}|{iteration}|", *texts)]
        s11 = choose(np.bincount(met, minlength=cells) if cells <= size else np.unique(met, return_counts=True)[1])
        return (m * s11 - s1 * s2) / spread if spread else float("nan")

    return over_iterations(df.sparkSession, n, correlation_of, "r")


def mantel_interpretation(r: Column, p: Column) -> Column:
    strength = (
        F.when(r > 0.7, "strong positive").when(r > 0.4, "moderate positive").when(r > 0.1, "weak positive")
        .when(r > -0.1, "negligible").otherwise("negative")
    )
    level = (
        F.when(p < 0.001, "highly significant (p < 0.001)").when(p < 0.01, "significant (p < 0.01)")
        .when(p < 0.05, "significant (p < 0.05)").otherwise("not significant (p >= 0.05)")
    )
    return F.concat_ws("; ", strength, level)


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information from the contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("na"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    choose = lambda c: F.sum(c * (c - 1) / 2.0)
    joined = attach(cells.join(ra, a).join(rb, b), total)
    mi = F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb").cast("double"))))
    one = joined.agg(choose(F.col("n")).alias("s11"), mi.alias("mi"))
    entropy = lambda c: -F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))
    sa = attach(ra, total).agg(choose(F.col("na")).alias("sa"), entropy("na").alias("ha"), F.count(F.lit(1)).alias("n_clusters_a"))
    sb = attach(rb, total).agg(choose(F.col("nb")).alias("sb"), entropy("nb").alias("hb"), F.count(F.lit(1)).alias("n_clusters_b"))
    x = attach(attach(attach(one, sa), sb), total)
    m = F.col("t") * (F.col("t") - 1) / 2
    expected = F.col("sa") * F.col("sb") / m
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("s11") - expected) / (top - expected))
    mean_h = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(mean_h == 0, 1.0).otherwise(F.col("mi") / mean_h)
    return x.select(
        F.round(ari, 6).alias("ari"), F.round(nmi, 6).alias("nmi"), F.col("t").cast("long").alias("n_proteins"),
        "n_clusters_a", "n_clusters_b",
    )


def assign_group(df: DataFrame, entity: str, labels: DataFrame, group: str, keywords: dict[str, Sequence[str]], default: str = "other") -> DataFrame:
    """Group from the label table, else the first group with a keyword inside the id."""
    text = F.upper(F.col(entity).cast("string"))
    by_word = F.lit(default)
    for name, words in reversed(list(keywords.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w.upper())
        by_word = F.when(hit, name).otherwise(by_word)
    known = labels.groupBy(entity).agg(F.min(group).alias("__g"))
    return df.join(known, entity, "left").withColumn(group, F.coalesce("__g", by_word)).drop("__g")


def feature_vectors(features: DataFrame, entity: str, feature: str) -> DataFrame:
    """Binary sparse vector per entity (column ``features``) over all features."""
    from pyspark.ml.feature import CountVectorizer

    distinct = features.select(entity, F.col(feature).cast("string").alias("__f")).dropna().distinct()
    docs = distinct.groupBy(entity).agg(F.array_sort(F.collect_list("__f")).alias("tokens"))
    every = max(distinct.select("__f").distinct().count(), 1)
    return CountVectorizer(inputCol="tokens", outputCol="features", binary=True, vocabSize=every).fit(docs).transform(docs).select(entity, "features")


def double_centred(pairs: DataFrame, ids: DataFrame, absent: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(cells, means): the Gower-centred matrix of a distance table, the input of principal coordinates.

    ``pairs`` holds (a < b, distance) nearer than ``absent``; every other pair is at
    that distance. ``means`` has (id, mean_square, grand_mean). ``cells`` has the
    centred value of the diagonal and of the pairs in the table; that of any other
    pair is ``-(absent ** 2 - mean_a - mean_b + grand_mean) / 2``, so the complete
    matrix is known without writing its cells; ``spectral`` has its eigenpairs.
    """
    known = pairs.select("a", "b", F.pow("distance", F.lit(2)).alias("d2"))
    every = ids.select("id").distinct()
    size = every.agg(F.count(F.lit(1)).alias("n"))
    ends = known.select(F.explode(F.array("a", "b")).alias("id"), "d2").groupBy("id").agg(F.sum("d2").alias("s"), F.count(F.lit(1)).alias("k"))
    rest = (F.col("n") - 1 - F.coalesce("k", F.lit(0))) * absent**2
    rows = attach(every.join(ends, "id", "left"), size).select("id", ((F.coalesce("s", F.lit(0.0)) + rest) / F.col("n")).alias("mean_square"))
    rows = materialise(rows, "row-means")
    means = attach(rows, rows.agg(F.avg("mean_square").alias("grand_mean")))
    cell = lambda d2, ma, mb: (d2 - ma - mb + F.col("grand_mean")) * -0.5
    off = (
        known.join(means.select(F.col("id").alias("a"), F.col("mean_square").alias("ma"), "grand_mean"), "a")
        .join(rows.select(F.col("id").alias("b"), F.col("mean_square").alias("mb")), "b")
        .select("a", "b", cell(F.col("d2"), F.col("ma"), F.col("mb")).alias("value"))
    )
    diagonal = means.select(F.col("id").alias("a"), F.col("id").alias("b"), cell(F.lit(0.0), F.col("mean_square"), F.col("mean_square")).alias("value"))
    return off.unionByName(diagonal), means


def ward_cuts(centres: np.ndarray, sizes: np.ndarray, ks: Sequence[int]) -> dict[int, list[int]]:
    """For each k the cluster (0..k-1, by smallest member) of every leaf under Ward linkage of leaf centres."""
    groups = {i: [i] for i in range(len(sizes))}
    centre, weight = {i: np.asarray(c, dtype=float) for i, c in enumerate(centres)}, {i: float(n) for i, n in enumerate(sizes)}
    cuts = {}
    while True:
        if len(groups) in ks:
            label = {leaf: c for c, members in enumerate(sorted(groups.values())) for leaf in members}
            cuts[len(groups)] = [label[i] for i in range(len(sizes))]
        if len(groups) <= max(1, min(ks)):
            return cuts
        keys = sorted(groups)
        cost = lambda a, b: weight[a] * weight[b] / (weight[a] + weight[b]) * float(((centre[a] - centre[b]) ** 2).sum())
        _, a, b = min((cost(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        total = weight[a] + weight[b]
        centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / total
        weight[a], groups[a] = total, sorted(groups[a] + groups.pop(b))
        centre.pop(b), weight.pop(b)


def cluster(features: DataFrame, entity: str, feature: str, k: int | None = None, k_max: int = 12, leaves: int = 48, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(labels, scores): ``labels`` is (entity, cluster), ``scores`` (k, silhouette, chosen) for k = 3..k_max, or the given k.

    One bisecting k-means fit makes ``leaves`` small clusters; Ward linkage of their
    centres merges them, and every k is a cut of that one tree. The exact
    Euclidean silhouette of every cut comes from one pass over all pairs, which
    sums the distances of each entity to each leaf. k ends below the number of
    entities; ties go to the smaller k. A cut that the tree lacks (fewer distinct
    sets) has no row; without any row the labels are the leaves.
    """
    from pyspark.ml.clustering import BisectingKMeans

    vectors = materialise(feature_vectors(features, entity, feature), "vectors")
    n = vectors.count()
    model = BisectingKMeans(k=max(2, min(leaves, n)), seed=seed, predictionCol="leaf", minDivisibleClusterSize=2.0).fit(vectors)
    placed = materialise(model.transform(vectors).select(entity, "leaf"), "leaves")
    counts = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = sorted(counts)  # at most ``leaves``
    centres = np.array([model.clusterCenters()[i] for i in used])
    ks = [k] if k else list(range(3, max(4, min(k_max, n - 1) + 1)))
    cuts = ward_cuts(centres, np.array([counts[i] for i in used]), ks)
    spark = features.sparkSession
    schema = "k int, silhouette double, chosen boolean"
    if not cuts:
        return placed.select(entity, F.col("leaf").alias("cluster")), spark.createDataFrame([], schema)
    sets, names = tiles.marked_sets(token_sets(features, entity, feature), placed, entity, "leaf")
    sums = materialise(tiles.distance_sums(sets), "leaf-distances")
    codes = {r.leaf: r.code for r in names.collect()}
    scores = []
    for c, cut in sorted(cuts.items()):
        moved = spark.createDataFrame([(codes[leaf], label) for leaf, label in zip(used, cut)], "code long, cut long")
        near = sums.join(F.broadcast(moved), F.col("label") == F.col("code")).groupBy("sid", F.col("cut").alias("label")).agg(F.sum("s").alias("s"))
        marks = sets.select("sid", F.explode("marks").alias("m")).join(F.broadcast(moved), F.col("m.label") == F.col("code"))
        relabelled = marks.groupBy("sid", "cut").agg(F.sum("m.m").alias("m")).groupBy("sid").agg(F.collect_list(F.struct(F.col("cut").alias("label"), "m")).alias("marks"))
        scores.append((c, tiles.silhouette_of(relabelled, near).first().silhouette or 0.0))
    best = max(scores, key=lambda x: (x[1], -x[0]))[0]
    final = spark.createDataFrame([(leaf, label) for leaf, label in zip(used, cuts[best])], "leaf int, cluster int")
    return placed.join(F.broadcast(final), "leaf").select(entity, "cluster"), spark.createDataFrame([(c, float(s), c == best) for c, s in scores], schema)
