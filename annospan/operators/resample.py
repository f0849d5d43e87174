"""Draws of entities as bit masks, counts of all draws in one aggregation.

Iteration ``i`` takes the ``k`` entities whose digest of (seed, i, entity) is
smallest. Instead of numbering one copy of every entity per iteration, the
digest of rank ``k`` (the *cut*) is found per iteration: tasks count digests by
leading digits, which names the bucket that holds it, and only rows of that
bucket are ordered. Tasks that hold the cuts then turn each entity into the bits of its
iterations without a shuffle, and the pairs travel once, with their mask, whatever ``n`` is.
Digests are made in numpy and never leave the task but for those of the buckets.

Null entities take no part. Entities are expected once per call; equal digests
are told apart by the entity, so a draw has exactly ``k`` members (all, if
there are fewer).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from annospan.functions.digests import digest_halves, text_array

WORD = 64  # iterations per mask word
DIGITS = 2  # leading hex digits that name a bucket of the digest: 256 buckets
PARTS = 256  # small batches that are sent as one
SIGN = np.uint64(1 << 63)  # signed numbers in the order of unsigned ones


@dataclass(frozen=True)
class Cuts:
    """Per stratum and iteration the digest, as two halves and the entity, up to which is drawn.

    Strata (few, in ascending order) that draw nothing are not among ``strata``; ``whole`` marks draws of everything.
    """

    strata: np.ndarray
    whole: np.ndarray
    high: np.ndarray
    low: np.ndarray
    text: list[dict[int, str]]

    def codes(self, stratum: np.ndarray) -> np.ndarray:
        """Numbers of the strata; the number behind the last one stands for all others."""
        at = np.searchsorted(self.strata, stratum)
        known = at < len(self.strata)
        known[known] = self.strata[at[known]] == stratum[known]
        return np.where(known, at, len(self.strata))

    def taken(self, i: int, code: np.ndarray, high: np.ndarray, low: np.ndarray, text: pa.Array) -> np.ndarray:
        """Entities that iteration ``i`` (from 0) draws."""
        if not len(self.strata):
            return np.zeros(len(code), bool)
        none = np.zeros(1, bool)
        top = np.append(self.high[:, i], np.uint64(0))[code]
        out = (high < top) | np.append(self.whole[:, i], none)[code]
        for r in np.flatnonzero((high == top) & ~out & (code < len(self.strata))):
            c = code[r]
            out[r] = (low[r], text[int(r)].as_py()) <= (self.low[c, i], self.text[c].get(i, ""))
        return out


def _drawn(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[tuple]:
    """(iteration from 0, batch, from, to, high, low) of the digests of rows with a ``__text``."""
    starts = [f"{seed}|{i}|" for i in range(1, n + 1)]
    for batch in batches:
        for k, start, end, high, low in digest_halves(starts, *text_array(batch.column("__text"))):
            yield k, batch, start, end, high, low


def digest_cuts(units: DataFrame, entity: str, quota: str, n: int, seed: int, stratum: str | None = None, floor: tuple[str | None, Cuts] | None = None) -> Cuts:
    """Cuts of ``n`` draws of the ``quota`` smallest digests of each stratum (a whole number; few strata).

    ``quota`` is the column with the number to draw, equal within a stratum.
    ``floor`` is the stratum column and the cuts of an earlier draw: only what that
    left out competes. A draw that wants more than there is takes everything.
    """
    group = (F.col(stratum) if stratum else F.lit(0)).cast("long").alias("__s")
    wanted = units.filter(F.col(entity).isNotNull() & (F.col(quota) > 0)).groupBy(group).agg(F.max(quota).cast("long").alias("q")).orderBy("__s").collect()
    strata, quotas = np.array([r["__s"] for r in wanted], "i8"), [r.q for r in wanted]
    size, buckets, digits = len(strata), 16**DIGITS, DIGITS
    cuts = Cuts(strata, np.ones((size, n), bool), np.zeros((size, n), "u8"), np.zeros((size, n), "u8"), [{} for _ in range(size)])
    if not size:
        return cuts
    before = F.col(floor[0]) if floor and floor[0] else F.lit(0)
    rows = units.filter(F.col(entity).isNotNull() & (F.col(quota) > 0)).select(F.col(entity).cast("string").alias("__text"), group, before.cast("long").alias("__f"))

    def competing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(iteration, strata numbers, text, high, low, bucket) of the digests that compete."""
        seen, code, below, text = None, None, None, None
        for k, batch, start, end, high, low in _drawn(batches, n, seed):
            if batch is not seen:
                seen, text = batch, batch.column("__text")
                code = cuts.codes(batch.column("__s").to_numpy())
                below = floor[1].codes(batch.column("__f").to_numpy()) if floor else None
            part, names = code[start:end], text.slice(start, end - start)
            left = part < size
            if floor:
                left &= ~floor[1].taken(k, below[start:end], high, low, names)
            bucket = (high >> np.uint64(64 - 4 * digits)).astype("i8")
            yield k, part, names, high, low, bucket, left

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((n, size * buckets), "i8")
        for k, code, _, _, _, bucket, left in competing(batches):
            held[k] += np.bincount((code * buckets + bucket)[left], minlength=size * buckets)
        counts = pa.ListArray.from_arrays(pa.array(np.arange(n * size + 1, dtype="i4") * buckets), pa.array(held.ravel()))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(n * size, dtype="i4")), "counts": counts})

    def crossing(counts: pa.Table) -> pa.Table:
        """The bucket in which the wanted rank lies, and the rank there."""
        at = counts.column("at")[0].as_py()
        upto = np.cumsum(counts.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, buckets).sum(axis=0))
        bucket = int(np.searchsorted(upto, quotas[at % size]))
        found = bucket < buckets
        need = quotas[at % size] - (int(upto[bucket - 1]) if bucket else 0)
        return pa.table({"at": pa.array([at] * found, pa.int32()), "bucket": pa.array([bucket] * found, pa.int32()), "need": pa.array([need] * found, pa.int64())})

    met = rows.mapInArrow(count, "at int, counts array<long>").groupBy("at").applyInArrow(crossing, "at int, bucket int, need long").collect()
    holds, ranks = np.full((n, size), -1, "i8"), np.zeros((n, size), "i8")
    for r in met:
        holds.flat[r.at], ranks.flat[r.at] = r.bucket, r.need

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names_of = [], ["at", "need", "high", "low", "text"]
        for k, code, names, high, low, bucket, left in competing(batches):
            pick = np.flatnonzero(left & (np.append(holds[k], -1)[code] == bucket))
            signed = [pa.array((x[pick] ^ SIGN).view("i8")) for x in (high, low)]
            at, need = k * size + code[pick], np.append(ranks[k], 0)[code[pick]]
            parts.append(pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(need), *signed, names.take(pa.array(pick))], names=names_of))
            if len(parts) == PARTS:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts = []
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    order = Window.partitionBy("at").orderBy("high", "low", "text")
    inside = rows.mapInArrow(near, "at int, need long, high long, low long, text string")
    for r in inside.withColumn("k", F.row_number().over(order)).filter("k = need").collect():
        i, s = divmod(r["at"], size)
        cuts.whole[s, i] = False
        cuts.high[s, i], cuts.low[s, i] = ((np.array([r.high, r.low], "i8").view("u8")) ^ SIGN)
        cuts.text[s][i] = r.text
    return cuts


def draw_masks(units: DataFrame, entity: str, n: int, seed: int, *rules: tuple[str | None, Cuts]) -> DataFrame:
    """(entity, mask): bit ``i - 1`` says that iteration ``i`` takes the entity.

    ``rules`` are stratum columns with their cuts; an entity is taken if any
    rule has a cut at or above its digest.
    """
    words = -(-n // WORD)
    names = [f"__rule{i}" for i in range(len(rules))]
    groups = [(F.col(c) if c else F.lit(0)).cast("long").alias(name) for (c, _), name in zip(rules, names)]
    rows = units.filter(F.col(entity).isNotNull()).select(entity, F.col(entity).cast("string").alias("__text"), *groups)
    schema = StructType([units.schema[entity], StructField("mask", ArrayType(LongType()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.zeros((batch.num_rows, words), "u8")
            codes = [cuts.codes(batch.column(name).to_numpy()) for (_, cuts), name in zip(rules, names)]
            text = batch.column("__text")
            for k, _, start, end, high, low in _drawn([batch], n, seed):
                taken, some = np.zeros(end - start, bool), text.slice(start, end - start)
                for (_, cuts), code in zip(rules, codes):
                    taken |= cuts.taken(k, code[start:end], high, low, some)
                masks[start:end, k // WORD] |= taken.astype("u8") << np.uint64(k % WORD)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype="i4") * words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(masks.view("i8").ravel()))], names=schema.names)

    return rows.mapInArrow(draw, schema)


def mask_rows(masks: DataFrame, entity: str) -> DataFrame:
    """(iteration, entity) rows of the masks, for results that list their draws."""
    words = masks.select(entity, F.posexplode("mask").alias("__w", "__word"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("getbit", F.col("__word"), b) == 1)
    return words.select("__w", F.explode(bits).alias("__b"), entity).select(
        (F.col("__w") * WORD + F.col("__b") + 1).alias("iteration"), entity
    )


def mask_counts(rows: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """(iteration, by, name): rows with the iteration's bit, zero counts left out.

    A row adds to 64 counters per mask word, which are summed before the shuffle:
    it carries one row of counters per (by, word), never a row per iteration.
    """
    by = list(by)
    words = rows.select(*by, F.posexplode("mask").alias("__w", "__word")).filter(F.col("__word") != 0)
    counters = words.groupBy(*by, "__w").agg(*[F.sum(F.getbit("__word", F.lit(b))).alias(f"__{b}") for b in range(WORD)])
    listed = counters.select(*by, "__w", F.posexplode(F.array(*[f"__{b}" for b in range(WORD)])).alias("__b", name))
    return listed.filter(F.col(name) > 0).select((F.col("__w") * WORD + F.col("__b") + 1).alias("iteration"), *by, name)
