"""Near duplicates among embeddings by lattice hashing with E8."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.llm import buffers
from annospan.llm.candidates import linked_members
from annospan.llm.components import components
from annospan.session import materialise

COSINE = 0.98
TABLES = 6  # at least
MOST_TABLES = 48
RECALL = 0.999
TRIALS = 2000
BLOCKS = 2
PROBES = 3
CELL = 8.0
ROWS_AT_ONCE = 2048
BLOCK_VALUES = 256 * 4096


def _shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i) for a, b in product((1, -1), repeat=2)]
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves)


SHORTEST = _shortest_vectors()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and if the sum is odd move the worst coordinate on."""
    near = np.rint(x)
    rest = x - near
    worst = np.abs(rest).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(rest, worst, -1) >= 0, 1.0, -1.0)
    moved = near.copy()
    np.put_along_axis(moved, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return np.where(near.sum(-1, keepdims=True) % 2 == 0, near, moved)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8: the better of D8 and D8 shifted by one half."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    better = ((x - whole) ** 2).sum(-1, keepdims=True) <= ((x - half) ** 2).sum(-1, keepdims=True)
    return np.where(better, whole, half)


@lru_cache(maxsize=8)
def projections(width: int, tables: int, seed: int = 3) -> np.ndarray:
    """(tables, width, 8 * BLOCKS) random directions, orthonormal where the width allows it."""
    rng = np.random.default_rng([seed, width])
    out = []
    for _ in range(tables):
        raw = rng.normal(size=(width, 8 * BLOCKS))
        out.append(np.linalg.qr(raw)[0] if width >= 8 * BLOCKS else raw / np.sqrt(width))
    return np.array(out)


def cell_size(width: int, cosine: float) -> float:
    """Size of a lattice step: ``CELL`` times the root mean square coordinate of a projected difference at the threshold."""
    return CELL * max(2 - 2 * cosine, 1e-12) ** 0.5 / width**0.5


def pairs_at(width: int, cosine: float, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random pairs of unit vectors at exactly this cosine (equal ones at width 1)."""
    a = rng.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if width == 1:
        return a, a
    b = rng.normal(size=(n, width))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + (1 - cosine * cosine) ** 0.5 * b


@lru_cache(maxsize=256)
def tables_for(width: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables with which pairs at the threshold, the hardest ones, share a cell with this probability.

    The same trial pairs are drawn wherever this is called. Raises an error where
    ``MOST_TABLES`` do not do.
    """
    a, b = pairs_at(width, cosine, TRIALS, np.random.default_rng([width, 11]))
    met = np.zeros(TRIALS, dtype=bool)
    for t in range(MOST_TABLES):
        x, y = cell_codes(a, t + 1, cosine=cosine, first=t), cell_codes(b, t + 1, cosine=cosine, first=t)
        met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
        if t + 1 >= TABLES and met.mean() >= recall:
            return t + 1
    raise ValueError(f"no {MOST_TABLES} tables reach a recall of {recall} at width {width} and cosine {cosine}")


def cell_codes(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, cosine: float = COSINE, first: int = 0) -> np.ndarray:
    """(rows, (tables - first) * (1 + probes)) codes of the home cell and of the ``probes`` closest neighbouring cells.

    Each table projects a unit vector to ``BLOCKS`` groups of eight coordinates
    and decodes each group to an E8 point; the points together name the cell. A
    neighbouring cell replaces points by one of their nearest neighbours, the
    cheapest replacements first.
    """
    n, width = unit.shape
    salt = np.random.default_rng(23).integers(1, 1 << 62, 8 * BLOCKS, dtype=np.int64) | 1
    options = [c for c in product(range(3), repeat=BLOCKS) if any(c)]
    out = np.empty((n, tables - first, 1 + probes), dtype=np.uint64)
    for t, directions in list(enumerate(projections(width, tables)))[first:]:
        x = (unit @ directions).reshape(n, BLOCKS, 8) / cell_size(width, cosine)
        home = nearest_e8(x)
        gain = (x - home) @ SHORTEST.T
        near = np.argpartition(-gain, 2, axis=-1)[..., :2]
        got = np.take_along_axis(gain, near, -1)
        order = np.argsort(-got, axis=-1)
        near, got = np.take_along_axis(near, order, -1), np.take_along_axis(got, order, -1)
        # a replaced point costs |v|^2 - 2 <rest, v> = 2 - 2 gain
        costs = np.concatenate([np.zeros((n, BLOCKS, 1)), 2 - 2 * got], axis=-1)
        points = np.concatenate([home[:, :, None], home[:, :, None] + SHORTEST[near]], axis=2)
        price = np.stack([sum(costs[:, b, c[b]] for b in range(BLOCKS)) for c in options], axis=1)
        chosen = np.argsort(price, axis=1, kind="stable")[:, :probes]
        picks = np.concatenate([np.zeros((n, 1, BLOCKS), dtype=int), np.array(options)[chosen]], axis=1)
        for k in range(1 + probes):
            point = np.take_along_axis(points, picks[:, k, :, None, None], axis=2).reshape(n, 8 * BLOCKS)
            code = (np.rint(2 * point).astype(np.int64) * salt).sum(axis=1).astype(np.uint64)
            out[:, t - first, k] = buffers.mixed(code ^ np.uint64(0x100000001B3 * (t + 1)))
    return out.reshape(n, -1)


def usable(vector: Column) -> Column:
    """Vectors without null, infinite or undefined entries and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def cells_of(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(id, weight, bucket) of rows (id, label, vec): distinct cells, parted by label and width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = unit_rows(batch.column("vec"))
            ids, labels, width = batch.column("id").to_numpy(), batch.column("label").to_numpy(), np.diff(ends)
            for w in np.unique(width):
                rows, tables = np.flatnonzero(width == w), tables_for(int(w), cosine)
                for k in range(0, len(rows), ROWS_AT_ONCE):
                    part = rows[k : k + ROWS_AT_ONCE]
                    x = values[ends[part][:, None] + np.arange(w)]
                    scaled = x / np.abs(x).max(axis=1, keepdims=True)
                    codes = cell_codes(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), tables, cosine=cosine)
                    tag = buffers.mixed(labels[part].astype(np.uint64) ^ np.uint64(0x100000001B3 * int(w)))
                    codes = np.sort(buffers.mixed(codes ^ tag[:, None]), axis=1)
                    fresh = np.ones(codes.shape, dtype=bool)
                    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
                    at = np.nonzero(fresh)
                    n = len(at[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part][at[0]]), pa.array(np.full(n, w, dtype=np.int64)), pa.array(codes[at].view(np.int64))], names=["id", "weight", "bucket"]
                    )

    return classes.select("id", F.col("label").cast("long").alias("label"), "vec").mapInArrow(run, "id long, weight long, bucket long")


def cosine_links(threshold: float):
    """Verifier: cosine of the whole vectors in double precision."""

    def units(table: pa.Table) -> np.ndarray:
        values, ends = unit_rows(table.column("vec").combine_chunks())
        x = values.reshape(table.num_rows, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge entries stay finite
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def verify(left: pa.Table, right: pa.Table | None) -> np.ndarray:
        a = units(left)
        return a @ (a if right is None else units(right)).T >= threshold

    return verify


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Two vectors of equal, known label link if their cosine reaches ``cosine``.
    Equal vectors are collapsed first; random projections are decoded to E8 points
    in several tables, each vector enters its own cell and the closest
    neighbouring ones, and the blocks that meet in a cell are verified with exact
    cosines. The size of the cells follows from width and threshold, the number of
    tables from trials at the threshold (``tables_for``). ``component_id`` is the
    smallest id reachable over links.

    Vectors that are null, empty, zero or hold null or non-finite entries, and
    those without a label, link with nothing. Vectors of different width do not
    meet. Repeated ids are separate vectors; an empty table gives no rows; other
    columns are ignored.
    """
    fits = usable(F.col(vector_col)) & F.col(label_col).isNotNull()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"),
        F.when(fits, F.xxhash64(label_col, vector_col)).alias("id"),
    )
    classes = rows.filter("id is not null").groupBy("id", "label").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")
    )
    classes = materialise(classes, "vectors")

    def payload(homes: DataFrame) -> DataFrame:
        return classes.select("id", "copies", "vec")

    found = linked_members(cells_of(classes, cosine), payload, cosine_links(cosine), BLOCK_VALUES)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    placed = (
        classes.select("id", "rep", "copies")
        .join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    placed = materialise(placed, "placed")
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(names, "root").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = rows.filter("id is not null").select("vec_id", "id").join(placed, "id").drop("id")
    alone = rows.filter("id is null").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    both = linked.unionByName(alone)
    return both.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
