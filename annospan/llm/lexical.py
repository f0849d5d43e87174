"""Ranked lexical search by a dual tree over items and documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from annospan.llm import buffers
from annospan.llm.tables import hash_share, written

TOP = 50
ITEM_BLOCK = 512
ITEM_BYTES = 4 << 20
DOCS_AT_ONCE = 1024
LEVELS = (64, 8, 1)  # documents of a node on each level of the document tree
ITEM_LEVELS = (16, 4, 1)  # items of a node on the matching level of the item tree
PIVOTS = 8
COLUMNS_AT_ONCE = 4096
FIRST_SAMPLE = 4096
SAMPLE_STEP = 64
EXACT = 1 << 53  # sums of whole numbers below this are exact in doubles
TERM = np.zeros(256, dtype=bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass(frozen=True)
class Sparse:
    """Rows of (column, value) with ascending columns."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def take(self, rows: np.ndarray) -> Sparse:
        counts = np.diff(self.ends)[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], counts)
        return Sparse(ends, self.columns[at], self.values[at])

    def maxima(self, size: int) -> Sparse:
        """One row per ``size`` rows in turn, with the largest value of each column."""
        node = self.owner() // size
        order = np.lexsort((self.columns, node))
        node, columns, values = node[order], self.columns[order], self.values[order]
        fresh = np.ones(len(node), dtype=bool)
        fresh[1:] = (node[1:] != node[:-1]) | (columns[1:] != columns[:-1])
        at = np.flatnonzero(fresh)
        top = np.maximum.reduceat(values, at) if len(at) else values
        n = -(-len(self) // size)
        return Sparse(np.searchsorted(node[at], np.arange(n + 1)), columns[at], top)

    def dense(self, rows: slice, place: np.ndarray, width: int) -> np.ndarray:
        """The rows as a matrix of ``width`` columns; ``place`` has that of each column here, -1 leaves one out."""
        low, high = self.ends[rows.start], self.ends[rows.stop]
        counts = np.diff(self.ends[rows.start : rows.stop + 1])
        own, at = np.repeat(np.arange(len(counts)), counts), place[self.columns[low:high]]
        met = at >= 0
        out = np.zeros((len(counts), width), dtype=self.values.dtype)
        out[own[met], at[met]] = self.values[low:high][met]
        return out

    def present(self, rows: slice, width: int) -> np.ndarray:
        """Which of ``width`` columns the rows hold."""
        out = np.zeros(width, dtype=bool)
        out[self.columns[self.ends[rows.start] : self.ends[rows.stop]]] = True
        return out


def products(a: Sparse, rows: slice, b: Sparse, others: slice, width: int) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b``, over bounded numbers of shared columns at a time."""
    columns = np.flatnonzero(a.present(rows, width) & b.present(others, width))
    out = np.zeros((rows.stop - rows.start, others.stop - others.start), dtype=a.values.dtype)
    place = np.full(width, -1)
    for at in range(0, len(columns), COLUMNS_AT_ONCE):
        part = columns[at : at + COLUMNS_AT_ONCE]
        place[part] = np.arange(len(part))
        out += a.dense(rows, place, len(part)) @ b.dense(others, place, len(part)).T
        place[part] = -1
    return out


def tree_order(rows: Sparse, leaf: int) -> np.ndarray:
    """Row numbers so that similar rows stand together.

    Rows go to the most similar of a few pivots, each pivot the row least similar to
    those before it, and each group is parted again until it fits into a leaf.
    """
    weight = np.maximum(np.bincount(rows.owner(), weights=rows.values, minlength=len(rows)), 1.0)
    near = np.zeros(int(rows.columns.max()) + 1 if len(rows.columns) else 0)

    def parted(part: np.ndarray) -> list[np.ndarray]:
        if len(part) <= leaf:
            return [part]
        own = rows.take(part)
        owner = own.owner()
        likeness = np.empty((0, len(part)))
        pivot = int(weight[part].argmax())
        for _ in range(min(PIVOTS, -(-len(part) // leaf))):
            held = own.columns[own.ends[pivot] : own.ends[pivot + 1]]
            near[held] = 1.0
            shared = np.bincount(owner, weights=own.values * near[own.columns], minlength=len(part)) / weight[part]
            near[held] = 0.0
            likeness = np.vstack([likeness, shared])
            pivot = int(likeness.max(axis=0).argmin())
        group = likeness.argmax(axis=0)
        if (group == group[0]).all():
            return [part]
        return [x for g in np.unique(group) for x in parted(part[group == g])]

    return np.concatenate(parted(np.arange(len(rows)))) if len(rows) else np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Items:
    """Items of a block in tree order: their vectors, the maxima of their nodes, and the hashes of their terms."""

    keys: list[str]
    terms: np.ndarray
    levels: list[Sparse]

    @property
    def count(self) -> int:
        return len(self.keys)


class Best:
    """The ``top`` best documents of each item so far, best first; ties go to the smaller order."""

    def __init__(self, items: int, top: int, floor: np.ndarray, dtype: type):
        self.top, self.floor = top, floor.astype(dtype)
        self.score: list[np.ndarray] = [np.zeros(0, dtype=dtype)] * items
        self.order: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * items
        self.row: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * items
        self.least = np.maximum(self.floor, 1)  # scores below this are not wanted

    def add(self, item: int, score: np.ndarray, order: np.ndarray, row: np.ndarray) -> None:
        score, order, row = np.concatenate([self.score[item], score]), np.concatenate([self.order[item], order]), np.concatenate([self.row[item], row])
        at = np.lexsort((row, order, -score))[: self.top]
        self.score[item], self.order[item], self.row[item] = score[at], order[at], row[at]
        if len(at) == self.top:
            self.least[item] = max(self.least[item], score[at[-1]])


def search(docs: Sparse, order: np.ndarray, rows: np.ndarray, items: Items, best: Best) -> int:
    """Put the documents of a batch into ``best``; returns the number of documents scored times items.

    Both trees are walked down together. The product of the coordinate maxima of a
    document node and an item node is at least every score below; where it is under
    the weakest wanted score of all its items, the pair of nodes is left.
    """
    place = tree_order(docs, LEVELS[-2])
    docs, order, rows = docs.take(place), order[place], rows[place]
    nodes = [docs.maxima(size) if size > 1 else docs for size in LEVELS]
    scored, last = 0, len(LEVELS) - 1
    stack = [(0, slice(0, len(nodes[0])), slice(0, len(items.levels[0])))]
    while stack:
        level, mine, theirs = stack.pop()
        bound = products(nodes[level], mine, items.levels[level], theirs, len(items.terms))
        size = ITEM_LEVELS[level]
        least = np.minimum.reduceat(best.least[theirs.start * size : min(theirs.stop * size, items.count)], np.arange(0, min(theirs.stop * size, items.count) - theirs.start * size, size))
        alive = bound >= least[None, :]
        if level == last:
            scored += alive.size
            for k in np.flatnonzero(alive.any(axis=0)):
                at = np.flatnonzero(alive[:, k])
                best.add(theirs.start + k, bound[at, k], order[mine.start + at], rows[mine.start + at])
            continue
        down, side = LEVELS[level] // LEVELS[level + 1], size // ITEM_LEVELS[level + 1]
        for d in np.flatnonzero(alive.any(axis=1))[np.argsort(bound[alive.any(axis=1)].max(axis=1), kind="stable")]:
            children = slice((mine.start + d) * down, min((mine.start + d + 1) * down, len(nodes[level + 1])))
            live = np.flatnonzero(alive[d])
            for run in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1):  # neighbours go down together
                stack.append((level + 1, children, slice((theirs.start + run[0]) * side, min((theirs.start + run[-1] + 1) * side, len(items.levels[level + 1])))))
    return scored


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of term bytes inside a row."""
    solid = TERM[data]
    inner = np.zeros(len(data) + 1, dtype=bool)
    inner[1:-1] = solid[1:] & solid[:-1]
    inner[offsets] = False
    starts = np.flatnonzero(solid & ~inner[:-1])
    return starts, np.flatnonzero(solid & ~inner[1:]) + 1, np.searchsorted(offsets, starts, side="right") - 1


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row, row, term hash, occurrences): distinct terms of each row, by row and hash."""
    starts, ends, row = term_spans(data, offsets)
    h = buffers.word_hashes(LOWER[data], starts, ends)
    n = np.bincount(row, minlength=len(offsets) - 1)
    at = np.lexsort((h, row))
    row, h = row[at], h[at]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(fresh)
    return n, row[first], h[first], np.diff(np.concatenate([first, [len(row)]]))


def document_terms(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(order, n, terms, counts) of documents (order, raw) with a term: n counts all terms, the lists hold those of ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.flat(batch.column("raw"))
            for a, b in buffers.chunks(offsets):
                part = offsets[a : b + 1]
                n, row, h, tf = term_counts(data[part[0] : part[-1]], part - part[0])
                place = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
                known = terms[place] == h if len(terms) else np.zeros(len(h), dtype=bool)
                ends = np.searchsorted(row[known], np.arange(b - a + 1))
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v[known].astype(np.int32)))
                out = pa.RecordBatch.from_arrays([batch.column("order").slice(a, b - a), pa.array(n.astype(np.int64)), lists(place), lists(tf)], names=["order", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select("order", "raw").mapInArrow(run, "order long, n long, terms array<int>, counts array<int>")


def item_vectors(texts: list[str]) -> tuple[np.ndarray, Sparse]:
    """(sorted term hashes, item rows over their numbers with value 1)."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    _, row, h, _ = term_counts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    terms, column = np.unique(h, return_inverse=True)
    return terms, Sparse(np.searchsorted(row, np.arange(len(texts) + 1)), column, np.ones(len(column)))


def weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; Python integers where 64 bits may not do."""
    if len(n) and int(n.max()) * documents * 50 >= 1 << 62:
        m = np.array([50 + (50 * int(x) * documents) // total for x in n], dtype=np.int64)
    else:
        m = 50 + (50 * n * documents) // max(total, 1)
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def found_in(vectors: DataFrame, items: Items, floor: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """(item, order, score): the best documents of each part of ``vectors`` that reach ``floor``."""
    largest = max((int(v.sum()) for v in np.split(items.levels[-1].values, items.levels[-1].ends[1:-1])), default=0)
    dtype = np.float64 if largest * 1_000_000 < EXACT else np.int64
    levels = [Sparse(s.ends, s.columns, s.values.astype(dtype)) for s in items.levels]
    block = Items(items.keys, items.terms, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.count, top, floor, dtype)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                lengths = part.column("terms").value_lengths().to_numpy()
                counts = part.column("counts").flatten().to_numpy().astype(np.int64)
                n = np.repeat(part.column("n").to_numpy(), lengths)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                docs = Sparse(ends, part.column("terms").flatten().to_numpy().astype(np.int64), impacts(counts, n, documents, total).astype(dtype))
                order = part.column("order").to_numpy()
                search(docs, order, np.zeros(len(order), dtype=np.int64), block, best)
        sizes = [len(s) for s in best.score]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), pa.array(np.concatenate(best.order)), pa.array(np.concatenate(best.score).astype(np.int64))],
            names=["item", "order", "score"],
        )

    return vectors.mapInArrow(run, "item int, order long, score long")


def block_items(texts: DataFrame, blocks: int, block: int) -> list:
    """(key, text) of one block of distinct item texts; about ``ITEM_BLOCK`` of them."""
    return texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "text").orderBy("key").collect()


def rank_block(docs: DataFrame, rows: list, top: int) -> DataFrame | None:
    """(key, rank, order, score) for one block of items; None if no item has a term."""
    terms, vectors = item_vectors([r.text for r in rows])
    if not len(terms):
        return None
    found = written(document_terms(docs, terms), "terms")
    documents, total = (int(x or 0) for x in found.agg(F.count(F.lit(1)), F.sum("n")).first())
    frequency = np.zeros(len(terms), dtype=np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        frequency[r.t] = r.df
    vectors = Sparse(vectors.ends, vectors.columns, weights(frequency, documents)[vectors.columns].astype(np.float64))
    place = tree_order(vectors, ITEM_LEVELS[-2])
    vectors = vectors.take(place)
    items = Items([rows[i].key for i in place], terms, [vectors.maxima(size) if size > 1 else vectors for size in ITEM_LEVELS])
    floor, share = np.zeros(len(rows)), FIRST_SAMPLE / max(documents, 1)
    while share < 1:  # a weakest score within a sample bounds that of all documents from below
        some = found_in(found.filter(hash_share("order") < share), items, floor, documents, total, top)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("rank") == top)
        for r in ranked.select("item", "score").collect():
            floor[r.item] = max(floor[r.item], r.score)
        share *= SAMPLE_STEP
    best = found_in(found, items, floor, documents, total, top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "order"))
    names = docs.sparkSession.createDataFrame([(i, k) for i, k in enumerate(items.keys)], "item int, key string")
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).join(F.broadcast(names), "item").select("key", "rank", "order", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item id, rank, id, score): the ``top`` documents of every item, highest score first, ties to the smaller id.

    Terms are runs of ASCII letters and digits and of any other characters beyond
    ASCII, A-Z lower-cased, known by 64-bit hashes. Scores are whole numbers: term
    weights by document frequency times saturated term counts.

    Items of equal text are searched once. They are taken in blocks of about
    ``ITEM_BLOCK``; a task holds one block and walks a tree over it together with a
    tree over each batch of documents. Node pairs whose coordinate maxima cannot
    reach the weakest of the best scores are left. Samples of growing share raise
    those scores first; all documents are then searched, so results are exact.

    Documents without a term (null and empty texts among them) count for nothing;
    items without a term, or with a null text, have no rows. Rows of equal item id
    are ranked each on their own. Repeated documents are separate ones; those of
    equal id and score are in any order, and a null id stands behind the others. Very
    long texts are taken one at a time. No documents or no items give no rows; other
    columns are ignored. Ids that are not whole numbers end the job.
    """
    number = F.col(id_col).cast("long")
    raw = docs.select(F.coalesce(number, F.lit((1 << 63) - 1)).alias("order"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    named = items.filter(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("text"), F.sha2(F.col(item_text), 256).alias("key"))
    texts = written(named.groupBy("key").agg(F.first("text").alias("text")), "items")
    count, size = (int(x or 0) for x in texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first())
    blocks = max(1, -(-count // ITEM_BLOCK), -(-size // ITEM_BYTES))
    ranked = None
    for block in range(blocks):
        rows = block_items(texts, blocks, block)
        part = rank_block(raw, rows, top) if rows else None
        if part is not None:
            part = written(part, "ranked") if blocks > 1 else part
            ranked = part if ranked is None else ranked.unionByName(part)
    schema = StructType([StructField(item_col, items.schema[item_col].dataType), *StructType().add("rank", "integer").add(id_col, "long").add("score", "long").fields])
    if ranked is None:
        return docs.sparkSession.createDataFrame([], schema)
    lost = F.when(F.col("order") < (1 << 63) - 1, F.col("order"))
    return named.select("item", "key").join(ranked, "key").select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), lost.alias(id_col), "score")
