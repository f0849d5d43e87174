"""Largest inner products by an adaptive dimension scan over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospan.llm.lattice import unit_rows, usable
from annospan.llm.tables import bounded_sample
from annospan.session import materialise

NEAREST = 20
FIT_ROWS = 4096
LIST_ROWS = 2048
MOST_LISTS = 1024
TARGET_RECALL = 0.97
COLUMN_BLOCK = 16
CERTAINTY = 2.1
CANDIDATES_AT_ONCE = 1024
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """Lloyd's centres of a bounded sample."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Bounded model of the table: a rotation, list centres, the number of lists to probe and a sample.

    A vector gets one more coordinate so that all have the norm of the longest;
    the largest inner product with a query is then the smallest distance. The
    extended vectors are rotated at random, so any leading coordinates are a fair
    sample of a distance.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, lists: int, nearest: int, recall: float):
        self.ids, self.vectors, self.norm, self.nearest = ids, vectors, norm, nearest
        width = vectors.shape[1] + 1
        self.rotation = np.linalg.qr(np.random.default_rng(4).normal(size=(width, width)))[0]
        placed = self.extend(vectors)
        self.centres = kmeans(placed, max(1, min(lists, len(ids))))
        self.probes = self.calibrate(placed, recall)

    def extend(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]]) @ self.rotation

    def turn(self, q: np.ndarray) -> np.ndarray:
        return q @ self.rotation[:-1]

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by the distance of their centres to (turned) queries."""
        return np.argsort((self.centres * self.centres).sum(1) - 2 * q @ self.centres.T, axis=1, kind="stable")

    def lists_of(self, placed: np.ndarray) -> np.ndarray:
        return self.order(placed)[:, 0]

    def calibrate(self, placed: np.ndarray, recall: float, queries: int = 256) -> int:
        """Fewest probes that find ``recall`` of the sample's own nearest neighbours."""
        k = min(self.nearest, len(placed) - 1)
        if len(self.centres) == 1 or k < 1:
            return len(self.centres)
        some = self.vectors[:queries]
        scores = some @ self.vectors.T
        scores[np.arange(len(some)), np.arange(len(some))] = -np.inf
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        rank = np.argsort(self.order(self.turn(some)), axis=1)
        needed = np.take_along_axis(rank, self.lists_of(placed)[near], axis=1)
        found = (needed[:, :, None] <= np.arange(len(self.centres))).mean(axis=(0, 1))
        return int(np.argmax(found >= recall)) + 1

    def bound(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A score that each query's nearest rows reach: that of its last sample neighbour, less what rounding may do."""
        scores = q @ self.vectors.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        if scores.shape[1] < self.nearest:
            return np.full(len(q), -np.inf)
        last = np.partition(scores, -self.nearest, axis=1)[:, -self.nearest]
        return last - 1e-12 * (self.norm * np.sqrt((q * q).sum(1)) + 1e-300)


def fit_index(rows: DataFrame, nearest: int, fit_rows: int, recall: float) -> Index | None:
    size = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not size[0]:
        return None
    sample = bounded_sample(rows.select("id", "vec"), ["id"], fit_rows).toPandas()
    lists = min(MOST_LISTS, -(-size[0] // LIST_ROWS))
    return Index(sample["id"].to_numpy(np.int64), np.array(sample["vec"].tolist(), dtype=np.float64), size[1], lists, nearest, recall)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, always summed in the same order: equal vectors get equal scores."""
    return np.multiply(a, b, order="C").sum(axis=1)


def adaptive_scan(queries: np.ndarray, bound: np.ndarray, candidates: np.ndarray, own: np.ndarray, norm: float, turned: np.ndarray, placed: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the pairs that are among each query's ``nearest`` here.

    Distances grow by blocks of rotated columns. After each block a pair is given
    up if its distance, scaled up to all columns, exceeds the query's threshold by
    more than chance allows; what remains is scored exactly on the original
    vectors. ``bound`` is a score the wanted pairs reach; it rises with the scan.
    """
    q_norm = (queries * queries).sum(1)
    width = turned.shape[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.full((len(queries), nearest), -np.inf)
    for at in range(0, len(candidates), CANDIDATES_AT_ONCE):
        part = placed[at : at + CANDIDATES_AT_ONCE]
        limit = np.maximum(q_norm + norm**2 - 2 * bound, 0)[:, None]
        alive = ~own[:, at : at + CANDIDATES_AT_ONCE]
        partial = np.zeros(alive.shape)
        rows, cols = None, None
        for lo in range(0, width, COLUMN_BLOCK):
            hi = min(lo + COLUMN_BLOCK, width)
            slack = limit * ((1 + CERTAINTY / np.sqrt(hi)) ** 2 if hi < width else 1) * hi / width + 1e-9 * (norm**2 + 1)
            a, b = turned[:, lo:hi], part[:, lo:hi]
            if rows is None:
                partial += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
                alive &= partial <= slack
                if alive.mean() < 0.2:  # few pairs are left: go on with them one by one
                    rows, cols = np.nonzero(alive)
                    left = partial[rows, cols]
            else:
                left += ((a[rows] - b[cols]) ** 2).sum(1)
                keep = left <= slack[rows, 0]
                rows, cols, left = rows[keep], cols[keep], left[keep]
        if rows is None:
            rows, cols = np.nonzero(alive)
        if not len(rows):
            continue
        score = exact_scores(queries[rows], candidates[at + cols])
        keep = score >= bound[rows]
        rows, cols, score = rows[keep], cols[keep], score[keep]
        found.append((rows, at + cols, score))
        order = np.lexsort((-score, rows))
        rank = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order], side="left")
        top = order[rank < nearest]
        fresh = np.full_like(best, -np.inf)
        fresh[rows[top], rank[rank < nearest]] = score[top]
        best = -np.partition(-np.hstack([best, fresh]), nearest - 1, axis=1)[:, :nearest]
        bound = np.maximum(bound, best.min(axis=1))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    row, col, score = (np.concatenate(c) for c in zip(*found))
    keep = score >= bound[row]
    return row[keep], col[keep], score[keep]


def nearest_vectors(vectors: DataFrame, query_step: int = 20, nearest: int = NEAREST, fit_rows: int = FIT_ROWS, recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``nearest`` largest inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_step``, candidates all
    rows but the query's own. A bounded sample gives the rotation, the list
    centres, the number of lists to probe (the fewest that reach ``recall`` inside
    the sample) and, for each query, a score that its neighbours must reach. Every
    row is put in its list; lists and the queries that probe them are cut into
    blocks, one job per pair of blocks, scanned by ``adaptive_scan``. Queries that
    find fewer than ``nearest`` rows of that score go through the remaining lists too.
    All rows of the result come from the scan and are scored by one routine.

    Vectors that are null, empty, zero or hold null or non-finite entries take no
    part, nor do rows without an id or of another width than most. Repeated rows
    (equal id and vector) count once; of one id no row is its own neighbour. With
    fewer candidates than ``nearest`` all are returned. An empty table gives no
    rows.
    """
    valid = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    doubles = valid.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).distinct()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    rows = materialise(doubles.withColumns({"norm": norm, "width": F.size("vec")}), "vectors")
    usual = rows.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).select("width")
    rows = rows.join(usual, "width", "left_semi")
    index = fit_index(rows, nearest, fit_rows, recall)
    result = "query_id long, vec_id long, score double"
    if index is None:
        empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return empty.withColumnRenamed("vec_id", id_col)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit_rows(batch.column("vec"))[0].reshape(batch.num_rows, -1)
            lists = index.lists_of(index.extend(x)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(lists, pa.int32())], names=["id", "vec", "list"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = unit_rows(batch.column("vec"))[0].reshape(batch.num_rows, -1)
            probes = index.order(index.turn(q)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(index.bound(batch.column("id").to_numpy(), q)), pa.array(list(probes), pa.list_(pa.int32()))],
                names=["id", "vec", "bound", "lists"],
            )

    base = rows.select("id", "vec")
    lists = materialise(base.mapInArrow(listed, "id long, vec array<double>, list int"), "lists")
    queries = base.filter(F.pmod("id", F.lit(query_step)) == 0)
    queries = materialise(queries.mapInArrow(routed, "id long, vec array<double>, bound double, lists array<int>"), "routes")
    sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).cast("int").alias("c_parts"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["list", "c", "q", "side", "id", "vec", "bound"]
    job = ["list", "c", "q"]

    def scanned(table: pa.Table) -> pa.RecordBatch | None:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        n = int((side == 0).sum())
        if n == 0 or n == len(ids):
            return None
        x = unit_rows(table.column("vec").combine_chunks())[0].reshape(len(ids), -1)
        own = ids[n:, None] == ids[None, :n]
        bound = table.column("bound").to_numpy()[n:]
        row, col, score = adaptive_scan(x[n:], bound, x[:n], own, index.norm, index.turn(x[n:]), index.extend(x[:n]), nearest)
        return pa.RecordBatch.from_arrays([pa.array(ids[n:][row]), pa.array(ids[:n][col]), pa.array(score)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in job])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and tuple(held[-1].column(c)[0].as_py() for c in job) != tuple(keys[a].tolist()):
                    if (out := scanned(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := scanned(pa.Table.from_batches(held))) is not None:
            yield out

    def scan(some: DataFrame, probed: Column) -> DataFrame:
        """(query_id, vec_id, score): what the probed lists hold for some queries, block by block."""
        probing = some.select("id", "vec", "bound", F.explode(probed).alias("list"))
        parts = F.broadcast(sizes.join(probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_parts")), "list"))  # a row per list
        left = lists.join(parts, "list").withColumns({"c": part("c_parts"), "q": every("q_parts"), "side": F.lit(0), "bound": F.lit(0.0)})
        right = probing.join(parts, "list").withColumns({"q": part("q_parts"), "c": every("c_parts"), "side": F.lit(1)})
        jobs = left.select(*columns).unionByName(right.select(*columns)).repartition(*job).sortWithinPartitions(*job, "side", "id")
        return materialise(jobs.mapInArrow(run, result), "hits")

    first, others = index.probes, len(index.centres) - index.probes
    hits = scan(queries, F.slice("lists", 1, first))
    if others:  # queries whose lists held too few go through all the other lists
        found = hits.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
        short = queries.join(found, queries["id"] == found["query_id"], "left").filter(F.coalesce("n", F.lit(0)) < nearest).select("id", "vec", "bound", "lists")
        hits = hits.unionByName(scan(short, F.slice("lists", first + 1, others)))
    found = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(id_col), "score")
