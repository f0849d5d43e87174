"""Packing of tokenized documents into sequences by vector best fit."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospan.llm.tables import unused
from annospan.operators.common import attach
from annospan.operators.ordered import ordered_scan, row_number
from annospan.session import materialise

LIMIT = 2048
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
CACHE_ENTRIES = 400_000
ROWS_PER_PART = 2048
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # small Latin-1 letters in UTF-8
CLAUSE_END = re.compile(rb"[,.](?:(?<=[a-z][,.])|(?<=\xc3[\x9f-\xb6\xb8-\xbf][,.]))")


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of white-space separated chunks, filled on demand.

    For tokenizers that drop white space and split at it, lower-case their input
    and start a new piece at a comma or full stop that follows a letter: their
    ids of a text are then the ids of its chunks, one after another. A chunk of
    small Latin-1 letters passes their normalizer and splitter unchanged and goes
    to the model itself, in the byte alphabet.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if LETTERS.fullmatch(chunk):
            word = text if chunk.isascii() else self.byte_level.pre_tokenize_str(text)[0][0]
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[chunk] = packed = np.array(ids, "<u4").tobytes()
        return packed

    def of(self, raw: bytes) -> bytes:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        if b"<|" not in raw:  # lower-casing could spell a special token
            raw = CLAUSE_END.sub(rb" \g<0>", raw.lower())
        return b"".join(map(self.__getitem__, raw.split()))


WORKER_CACHES: dict[str, WordIds] = {}


def slices(raw: bytes) -> Iterator[bytes]:
    """The text in parts of about a megabyte, cut at spaces."""
    at = 0
    while at < len(raw):
        cut = raw.find(b" ", at + SLICE_BYTES)
        cut = len(raw) if cut < 0 else cut
        yield raw[at:cut]
        at = cut


def whole_text_ids(path: str, raw: bytes) -> Iterator[bytes]:
    """Ids of any tokenizer: one call for the whole text."""
    tokenizer = WORKER_CACHES.setdefault(path, WordIds(path)).tokenizer
    yield np.array(tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    end_id: int = 0,
    by_word: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids): every document's tokens and the end id, cut at ``limit``.

    ``ids`` holds little-endian unsigned 32-bit ids. Only documents longer than
    ``limit`` are cut, the last piece may be shorter; null or empty text gives one
    piece with the end id. ``by_word`` uses the chunk cache of ``WordIds``; switch
    it off for tokenizers that keep white space. ``tokenizer_path`` must exist on
    the executors. Long texts are tokenized in slices, pieces leave as they fill.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])
    width = 4 * limit

    def pieces_of(raw: bytes) -> Iterator[bytes]:
        if by_word:
            words = WORKER_CACHES.get(tokenizer_path)
            if words is None:
                words = WORKER_CACHES[tokenizer_path] = WordIds(tokenizer_path)
            parts = map(words.of, slices(raw))
        else:
            parts = whole_text_ids(tokenizer_path, raw)
        kept = b""
        for part in chain(parts, [end]):
            kept += part
            full = len(kept) // width
            for k in range(full):
                yield kept[k * width : (k + 1) * width]
            kept = kept[full * width :]
        if kept:
            yield kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, ids in enumerate(pieces_of(raw.as_py())):
                    rows.append((key, n, n * limit, len(ids) // 4, ids))
                    held += len(ids)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")
    pieces = docs.select(F.col(id_col).cast("long").alias("id"), raw).mapInArrow(
        run, "id long, piece int, start long, length int, ids binary"
    )
    return pieces.withColumnRenamed("id", id_col)


class Bins(NamedTuple):
    """Placements: ranks ``first ..`` of a length go to ``n_bins`` bins, ``each`` per bin."""

    length: np.ndarray
    first: np.ndarray
    n_bins: np.ndarray
    each: np.ndarray
    bin_start: np.ndarray
    offset: np.ndarray
    total: int


def best_fit(
    lengths: Sequence[int],
    counts: Sequence[int],
    tokens: int = LIMIT,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    score: str = "norm",
) -> Bins:
    """Best fit decreasing over a histogram of lengths, under three capacities.

    A piece of length ``n`` needs ``n`` tokens, one document and ``n * n``
    attention cost. Pieces go longest first into the open bin that can take them
    and has the smallest weighted norm of what stays free (``norm``) or the
    largest weighted dot product of need and free room (``dot``); a new bin opens
    when none can. Bins of equal content are one run of numbers, so the work
    depends on the number of distinct lengths and not on the number of pieces.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score must be norm or dot")
    capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.float64)
    weight = np.array(weights) / capacity**2
    free = np.zeros((0, 3))
    start, size, used = (np.zeros(0, dtype=np.int64) for _ in range(3))
    rows: list[tuple] = []
    total = 0
    order = sorted((int(n), int(c)) for n, c in zip(lengths, counts) if c)
    smallest = order[0][0] if order else 0
    for length, count in reversed(order):
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        first = 0
        while count:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                rest = free[fits] - need
                value = (rest * rest) @ weight if score == "norm" else -(free[fits] * need) @ weight
                at = fits[np.argmin(value)]
                room, base, many, filled = free[at], start[at], size[at], used[at]
            else:
                at, room, base, many, filled = -1, capacity, total, count, 0
            each = int(min((room // need).min(), count))
            bins = int(min(many, count // each))
            placed = bins * each
            rows.append((length, first, bins, each, base, filled))
            left = room - need * each
            if at < 0:
                total += bins
            elif bins == many:
                free, start, size, used = (np.delete(x, at, axis=0) for x in (free, start, size, used))
            else:
                start[at] += bins
                size[at] -= bins
            if left[0] >= smallest and left[1] >= 1 and left[2] >= smallest * smallest:
                free = np.vstack([free, left])
                start, size = np.append(start, base), np.append(size, bins)
                used = np.append(used, filled + length * each)
            first += placed
            count -= placed
    columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    return Bins(*columns, total)


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", tokens: int = LIMIT, **capacities) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: packed into as few sequences as best fit finds.

    Needs ``id_col``, ``piece`` and ``length`` (at most ``tokens``); other columns
    pass through. Only the histogram of lengths (at most ``tokens`` numbers)
    reaches the driver. Pieces are ranked within their length by a scan over hash
    parts, so one length may hold any share of them, and a rank finds its place by
    binary search in the placements. Repeated rows are pieces of their own.
    """
    rows = materialise(pieces, "pieces")
    h, of, rank = (unused(pieces, c) for c in ("place_hash", "place_parts", "place_rank"))
    histogram = rows.groupBy("length").count().collect()
    plan = best_fit([r["length"] for r in histogram], [r["count"] for r in histogram], tokens, **capacities)
    parts = attach(
        rows.withColumn(h, F.xxhash64(id_col, "piece")),
        rows.agg(F.greatest(F.lit(1), F.expr(f"count(1) div {ROWS_PER_PART}")).alias(of)),
    )
    part = F.floor((F.col(h) / F.lit(2.0**64) + F.lit(0.5)) * F.col(of))
    ranked = ordered_scan(parts, ["length"], part, [h, id_col, "piece"], **{rank: row_number()}).drop(h, of)
    span = 1 << 44
    keys = plan.length * span + plan.first
    order = np.argsort(keys)
    keys, each, base, offset = keys[order], plan.each[order], plan.bin_start[order], plan.offset[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            key = length * span + batch.column(rank).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            at = np.searchsorted(keys, key, side="right") - 1
            n = key - keys[at]
            names = [c for c in batch.schema.names if c != rank]
            columns = [batch.column(c) for c in names]
            columns += [pa.array(base[at] + n // each[at]), pa.array(offset[at] + n % each[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != rank)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", **capacities) -> DataFrame:
    """Packed pieces with their token ids: ``token_pieces`` followed by ``pack_pieces``."""
    return pack_pieces(token_pieces(docs, tokenizer_path, limit, id_col=id_col, text_col=text_col), id_col, limit, **capacities)
