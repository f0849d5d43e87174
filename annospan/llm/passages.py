"""Repeated passages: substring de-duplication with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from annospan.llm import buffers
from annospan.llm.tables import hash_share, written

WORDS = 20
#: Perfect difference covers by period (fixed values): any two residues meet in a cover position after the same step.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
HOT_SAMPLE = 20_000
HOT_KEYS = 4096
HOT_PARTS = 64
LAST_ID = (1 << 63) - 1
OTHER = np.uint64(0xD6E8FEB86659FD93)


def cover_plan(words: int) -> tuple[int, int]:
    """(period, anchor words): the largest period whose anchors keep at least a third of the window.

    A window of ``words`` holds, in each of its first ``period`` positions, a whole
    anchor of ``words - period + 1`` words.
    """
    period = max(p for p in COVERS if p == 1 or 3 * (words - p + 1) >= words)
    return period, words - period + 1


class Text:
    """Word hashes of the rows of a buffer, and hashes of runs of words that stay inside a row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.rows = buffers.word_spans(data, offsets)
        self.first = np.searchsorted(self.rows, np.arange(len(offsets)))  # first word of each row
        self.place = np.arange(len(self.rows)) - self.first[self.rows]
        self.hashes = buffers.word_hashes(data, self.starts, self.ends)

    def runs(self, words: int, salt: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
        """(hash, inside) of the run of ``words`` at every word; ``inside`` if it ends in the same row."""
        n = len(self.hashes)
        if n < words:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        values = self.hashes if salt == 0 else buffers.mixed(self.hashes ^ salt)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * buffers.FORWARD.upto(n), out=sums[1:])
        run = (sums[words:] - sums[: n - words + 1]) * buffers.BACKWARD.upto(n)[: n - words + 1]
        return buffers.mixed(run + np.uint64(words)), self.rows[words - 1 :] == self.rows[: n - words + 1]


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, Text]]:
    """(first row, end row, Text) of a binary column in pieces of bounded size."""
    data, offsets = buffers.flat(column)
    for a, b in buffers.chunks(offsets):
        part = offsets[a : b + 1]
        yield a, b, Text(data[part[0] : part[-1]], part - part[0])


def anchors(docs: DataFrame, words: int) -> DataFrame:
    """(pos, key, tag, hash): the anchors of documents (key, raw) at cover positions of the period; ``tag`` is 0."""
    period, length = cover_plan(words)
    covered = np.isin(np.arange(period), COVERS[period])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for a, _, text in texts_of(batch.column("raw")):
                h, inside = text.runs(length)
                at = np.flatnonzero(inside & covered[text.place[: len(h)] % period])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text.place[at].astype(np.int32)), pa.array(keys[a + text.rows[at]]), pa.array(np.zeros(len(at), dtype=np.int64)), pa.array(h[at].view(np.int64))],
                    names=["pos", "key", "tag", "hash"],
                )

    return docs.select("key", "raw").mapInArrow(run, "pos int, key long, tag long, hash long")


def hot_keys(sample: DataFrame) -> DataFrame:
    """(hash, tag) that hold at least 1 / ``HOT_KEYS`` of a sample, so at most that many rows.

    Only how rows are dealt to tasks depends on it; every key found here does
    occur several times.
    """
    counts = written(sample.groupBy("hash", "tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 8"), "frequent")
    total = sample.count()
    return counts.filter(F.col("n") * HOT_KEYS >= total).select("hash", "tag")


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows whose hot keys are spread over parts by document: the low half of their ``tag``, 0 for all other keys.

    The order of columns keeps what changes from row to row together, for the
    compression of the shuffle.
    """
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["hash", "tag"], "left")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(HOT_PARTS)) + 1).otherwise(0)
    return marked.withColumn("tag", F.col("tag") + part).select(*rows.columns)


def part_of(tag: str) -> Column:
    return F.col(tag).bitwiseAND(F.lit(0xFFFFFFFF))


def shared_anchors(docs: DataFrame, share: float, words: int) -> DataFrame:
    """(key, spots): for each document the positions of its anchors that occur more than once in the corpus."""
    rows = dealt(anchors(docs, words), hot_keys(anchors(docs.filter(hash_share("key") < share), words)))
    n = F.count(F.lit(1)).over(Window.partitionBy("hash", "tag"))
    shared = rows.withColumn("n", n).filter((part_of("tag") > 0) | (F.col("n") > 1))
    return shared.groupBy("key").agg(F.collect_set("pos").alias("spots"))


def windows(found: DataFrame, words: int) -> DataFrame:
    """(start, doc, key, tag, hash): windows that hold a shared anchor, of rows (key, doc, raw, spots).

    An anchor at ``a`` is extended to the windows that start in the period up to it.
    ``hash`` and the high half of ``tag`` are 96 bits of two independent hashes of
    the words.
    """
    period, _ = cover_plan(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            spots, counts = batch.column("spots").flatten().to_numpy(), batch.column("spots").value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(counts)])
            for a, b, text in texts_of(batch.column("raw")):
                h, inside = text.runs(words)
                more, _ = text.runs(words, OTHER)
                near = np.zeros(len(text.rows) + 1, dtype=np.int64)
                at = spots[ends[a] : ends[b]] + np.repeat(text.first[: b - a], counts[a:b])
                low = np.maximum(at - period + 1, np.repeat(text.first[: b - a], counts[a:b]))
                np.add.at(near, low, 1)
                np.add.at(near, at + 1, -1)
                at = np.flatnonzero(inside & (np.cumsum(near)[: len(h)] > 0))
                rows = a + text.rows[at]
                tag = more[at] >> np.uint64(32) << np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text.place[at].astype(np.int32)), pa.array(docs[rows]), pa.array(keys[rows]), pa.array(tag.view(np.int64)), pa.array(h[at].view(np.int64))],
                    names=["start", "doc", "key", "tag", "hash"],
                )

    return found.select("key", "doc", "raw", "spots").mapInArrow(run, "start int, doc long, key long, tag long, hash long")


def later_windows(found: DataFrame, share: float, words: int) -> DataFrame:
    """(key, starts): for each document the windows whose words also start earlier.

    The first occurrence is a minimum per window. That of a hot window is taken in
    parts, one row per part stays open, and the parts' minima decide those.
    """
    place, part = F.struct("doc", "start"), part_of("tag")
    rows = dealt(windows(found, words), hot_keys(windows(found.filter(hash_share("key") < share), words)))
    least = F.min(place).over(Window.partitionBy("hash", "tag"))
    told = rows.withColumn("later", place > least).filter((part > 0) | F.col("later"))
    open_only = lambda c: F.when(~F.col("later"), c)
    judged = written(told.select("key", "start", open_only(F.col("doc")).alias("doc"), open_only(F.col("tag") - part).alias("tag"), open_only(F.col("hash")).alias("hash")), "windows")
    unsure = judged.filter("hash is not null")  # at most HOT_KEYS * HOT_PARTS places, repeated rows aside
    first = unsure.groupBy("hash", "tag").agg(F.min(place).alias("least"))
    resolved = unsure.join(F.broadcast(first), ["hash", "tag"]).filter(place > F.col("least"))
    every = judged.filter("hash is null").select("key", "start").unionByName(resolved.select("key", "start"))
    return every.groupBy("key").agg(F.collect_set("start").alias("starts"))


def cut(rows: DataFrame, words: int, id_field: StructField) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of rows (id, raw, starts)."""
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType().add(id_field).add("n_words", "long").add("n_removed", "long").add("spans", ArrayType(span)).add("kept", "string")
    names = schema.names
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("starts")
            starts, counts = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(counts)])
            for a, b, text in texts_of(batch.column("raw")):
                n = len(text.rows)
                cover = np.zeros(n + 1, dtype=np.int64)
                at = starts[ends[a] : ends[b]].astype(np.int64) + np.repeat(text.first[: b - a], counts[a:b])
                np.add.at(cover, at, 1)
                np.add.at(cover, at + words, -1)
                gone = np.cumsum(cover)[:n] > 0
                n_words = np.diff(text.first)
                n_gone = np.bincount(text.rows[gone], minlength=b - a)
                # bytes that stay: words that stay and one blank before each but the first of a row
                stay = np.flatnonzero(~gone)
                follows = np.zeros(len(stay), dtype=bool)
                follows[1:] = text.rows[stay[1:]] == text.rows[stay[:-1]]
                data = text.data.copy()
                data[text.starts[stay[follows]] - 1] = 0x20
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                edge[text.starts[stay] - follows] += 1
                np.add.at(edge, text.ends[stay], -1)
                mask = np.cumsum(edge)[:-1] > 0
                kept_ends = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[text.offsets]
                # runs of removed words
                flag = np.concatenate([[False], gone, [False]])
                fresh = np.zeros(n + 1, dtype=bool)
                fresh[text.first[text.first < n]] = True
                open_at = np.flatnonzero(flag[1:-1] & (~flag[:-2] | fresh[:n]))
                close_at = np.flatnonzero(flag[1:-1] & (~flag[2:] | fresh[1:])) + 1
                base = text.first[text.rows[open_at]]
                spans = pa.StructArray.from_arrays([pa.array((open_at - base).astype(np.int32)), pa.array((close_at - base).astype(np.int32))], fields=list(span_type))
                n_spans = np.concatenate([[0], np.cumsum(np.bincount(text.rows[open_at], minlength=b - a))])
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(kept_ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[mask]))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(n_spans.astype(np.int32)), spans), kept.cast(pa.binary()).cast(pa.string()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every document.

    Words are runs of anything but ASCII white space, unchanged. A window is
    ``words`` consecutive words of one document; every word of a window whose words
    also start earlier (in a document of smaller id, or before it in the same one)
    is removed. Windows are judged on the input. ``kept`` joins the other words by
    one space, ``spans`` are the removed runs as [start, end) in words.

    Anchors, shorter runs of words, are hashed only at cover positions modulo a
    period; two equal windows always share an anchor at the same step from their
    starts. Anchors that occur once are dropped; the others are extended to all windows that
    hold them, and the smallest (id, start) of each window is its first occurrence.

    A null text is empty; a text shorter than a window loses nothing. A null id
    counts as the largest. Rows of equal id are one document as far as order goes:
    of windows with equal id and start neither is earlier, so repeated rows get equal
    results. Very long texts are taken one at a time. An empty table gives no rows; other columns
    are ignored. Ids that are not whole numbers end the job.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    number = F.col(id_col).cast("long")
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(number, F.lit(LAST_ID)).alias("doc"), raw.alias("raw"),
        F.xxhash64(number, F.coalesce(F.col(text_col), F.lit(""))).alias("key"),
    )
    share = min(1.0, HOT_SAMPLE / max(docs.count(), 1))
    spots = written(shared_anchors(rows, share, words), "anchors")
    found = written(rows.drop("id").join(spots, "key"), "marked")
    starts = later_windows(found, share, words)
    id_field = StructField(id_col, docs.schema[id_col].dataType)
    return cut(rows.join(starts, "key", "left").select("id", "raw", "starts"), words, id_field)
