"""Whitening of embeddings from exact sums of squares (polarisation)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from annospan.session import materialise

SCALE = 256
COMPONENTS = 4
ROWS_AT_ONCE = 4096
LIMB = 21
SAFE = 1 << 61  # |n * x - S| below this: a sum of two fits three limbs
DIGIT = 60
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """Model of one width: components are columns of ``axes``, falling by ``eigenvalues``."""

    n: int
    sums: list[int]
    largest: int
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    real: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where that holds, else Python integers."""
        return centred(x, self.n, self.sums, self.largest)

    def white(self, y: np.ndarray) -> np.ndarray:
        """Projections of x - S / n over the root of the eigenvalue; zero where there is no variance."""
        scaled = (y / self.n).astype(np.float64) @ self.axes
        return np.where(self.real, scaled / np.sqrt(np.where(self.real, self.eigenvalues, 1.0)), 0.0)


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    if n * largest * 2 < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every entry as long, at the ends of the range of long beyond them."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def complete(vector: Column) -> Column:
    """Vectors that are not null and hold only finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix) of a list column, at most ``ROWS_AT_ONCE`` rows at a time."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(width) - width
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[at : at + ROWS_AT_ONCE]
            yield int(w), part, values[starts[part][:, None] + np.arange(w)]


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns as Python integers."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def square_sums(z: np.ndarray) -> np.ndarray:
    """Exact sum of squares of each column as Python integers; 64-bit entries go through three limbs."""
    if z.dtype == object:
        return (z * z).sum(axis=0)
    mask = (1 << LIMB) - 1
    a, b, c = z >> (2 * LIMB), (z >> LIMB) & mask, z & mask
    dot = lambda p, q: np.einsum("ij,ij->j", p, q).astype(object)
    one = 1 << LIMB
    return dot(a, a) * one**4 + dot(a, b) * 2 * one**3 + (2 * dot(a, c) + dot(b, b)) * one**2 + dot(b, c) * 2 * one + dot(c, c)


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums of (y_i + y_j) ** 2 for i <= j, row by row of the upper triangle."""
    return np.concatenate([square_sums(y[:, i:] + y[:, i : i + 1]) for i in range(y.shape[1])])


def exact_totals(fit: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, list[int]]:
    """For each width the totals over all vectors of what ``of`` gives for a matrix of them.

    A task adds its matrices up and returns one row per number and 60-bit digit;
    Spark adds the digits as decimals, so the totals are exact at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, _, x in by_width(batch.column(0)):
                got = of(w, x)
                held[w] = held[w] + got if w in held else got
        for w, totals in held.items():
            at, place, part = [], [], []
            for k, total in enumerate(totals):
                sign, rest, digit = (-1 if total < 0 else 1), abs(int(total)), 0
                while rest or digit == 0:
                    at.append(k)
                    place.append(digit)
                    part.append(sign * (rest & ((1 << DIGIT) - 1)))
                    rest, digit = rest >> DIGIT, digit + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), w, dtype=np.int32)), pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(part, pa.int64())],
                names=["width", "at", "place", "part"],
            )

    digits = fit.select("x").mapInArrow(run, "width int, at int, place int, part long")
    sums = digits.groupBy("width", "at", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).toArrow()
    out: dict[int, dict[int, int]] = {}
    for w, k, place, total in zip(*(sums.column(c).to_pylist() for c in ("width", "at", "place", "total"))):
        numbers = out.setdefault(w, {})
        numbers[k] = numbers.get(k, 0) + (int(total) << (DIGIT * place))
    return {w: [numbers[k] for k in sorted(numbers)] for w, numbers in out.items()}


def covariance(squares: list[int], width: int, n: int) -> np.ndarray:
    """Covariances from sums of squared pair sums: half of what the square of a sum exceeds the single squares by.

    All differences are of integers; each covariance is rounded once.
    """
    whole = np.zeros((width, width), dtype=object)
    whole[np.triu_indices(width)] = squares
    own = np.array([whole[i, i] // 4 for i in range(width)], dtype=object)
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (whole[i, j] - own[i] - own[j]) / (2 * n**3)
    return out


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Models by width from the distinct vectors ``fit`` (column x, array of long).

    The driver gets width * (width + 1) / 2 sums for each width that occurs.
    """
    ends = fit.filter("size(x) > 0").select(F.size("x").alias("width"), F.array_max("x").alias("high"), F.array_min("x").alias("low"))
    bounds = {r.width: (r.n, max(r.high, -r.low)) for r in ends.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("high"), F.min("low").alias("low")).collect()}
    filled = fit.filter("size(x) > 0")
    sums = exact_totals(filled, lambda w, x: column_sums(x))
    known = {w: (n, sums[w], largest) for w, (n, largest) in bounds.items()}
    squares = exact_totals(filled, lambda w, x: pair_squares(centred(x, *known[w])))
    models = {}
    for w, (n, total, largest) in known.items():
        v = covariance(squares[w], w, n)
        values, axes = np.linalg.eigh(v)
        top = np.argsort(-values, kind="stable")[: min(components, w)]
        values, axes = values[top], axes[:, top]
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(top))] < 0, -1.0, 1.0)
        real = values > max(values.max(), 0.0) * w * np.finfo(np.float64).eps
        trace = float(np.trace(v))
        explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(top))
        models[w] = Whitening(n, total, largest, axes, values, explained, real)
    return models


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured on the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, _, x in by_width(batch.column(0)):
                white = models[w].white(models[w].centred(x))
                flat = np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(flat), w, dtype=np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["width", "at", "part"]
                )

    parts = fit.filter("size(x) > 0").select("x").mapInArrow(run, "width int, at int, part double")
    totals: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("width", "at").agg(F.sum("part").alias("total")).collect():
        totals.setdefault(r.width, {})[r.at] = r.total
    out = {}
    for w, model in models.items():
        k, got = len(model.eigenvalues), totals[w]
        mean = np.array([got[i] for i in range(k)]) / model.n
        cov = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / model.n - np.outer(mean, mean)
        off = np.abs(cov - np.eye(k))[np.ix_(model.real, model.real)]
        out[w] = float(off.max()) if off.size else 0.0
    return out


def whiten_vectors(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, width, n, deviation, whitened, explained, identity_error) of every complete vector.

    Entries become x = floor(scale * c). The covariance of the distinct x vectors is
    recovered by polarisation: exact sums of squares of the centred values
    n * x - S of every dimension and of the sum of every two dimensions differ by
    twice the cross term. ``whitened`` and ``explained`` hold a number for each of
    the leading ``components`` (all, if the vectors are narrower), ``deviation`` is the exact
    squared distance of n * x from S, null where it exceeds a long.

    Vectors that are null or hold null or non-finite entries have no row. Vectors of
    different width are fitted apart; an empty vector has no components: empty
    arrays and a null n. Entries beyond the range of long stand at its ends. Copies weigh once
    in the fit and are all returned, repeated and null ids as well. Components
    without variance (one distinct vector, or fewer than dimensions) are 0, with
    ``explained`` at most rounding; they do not enter ``identity_error``. Equal
    eigenvalues may share their plane in any rotation. An empty table gives no
    rows; other columns are ignored.
    """
    kept = vectors.filter(complete(F.col(vector_col))).select(F.col(id_col), whole_numbers(F.col(vector_col), scale).alias("__x"))
    fit = materialise(kept.select(F.col("__x").alias("x")).distinct(), "whitening")
    models = fit_whitening(fit, components)
    errors = identity_errors(fit, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows, x in by_width(batch.column(1)):
                ids = batch.column(0).take(pa.array(rows))
                if w == 0:
                    empty = pa.array([[]] * len(rows), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([0] * len(rows), pa.int64()), pa.array([None] * len(rows), pa.int64()), pa.array([0] * len(rows), pa.int64()), empty, empty, pa.array([0.0] * len(rows))],
                        names=names,
                    )
                    continue
                model, k = models[w], len(models[w].eigenvalues)
                y = model.centred(x)
                squares = (y.astype(object) ** 2).sum(axis=1) if y.dtype == object or int(np.abs(y).max()) ** 2 * w > LONG else (y * y).sum(axis=1)
                lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.full(len(rows), w)), pa.array(np.full(len(rows), model.n)),
                        pa.array([int(s) if s <= LONG else None for s in squares], pa.int64()),
                        lists(model.white(y)), lists(np.tile(model.explained, (len(rows), 1))), pa.array(np.full(len(rows), errors[w])),
                    ],
                    names=names,
                )

    schema = StructType([
        kept.schema[0], StructField("width", LongType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", ArrayType(DoubleType())), StructField("explained", ArrayType(DoubleType())), StructField("identity_error", DoubleType()),
    ])
    names = schema.names
    return kept.mapInArrow(run, schema)
