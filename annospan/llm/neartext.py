"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.llm import buffers
from annospan.llm.candidates import linked_members
from annospan.llm.components import components
from annospan.llm.tables import unused
from annospan.session import materialise

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK_SHINGLES = 400_000
COLUMNS_AT_ONCE = 4096


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which ``recall`` is reached at ``threshold`` in ``most`` hashes.

    Two sets of similarity s agree in a band of r rows with probability s**r, so
    b bands miss the pair with probability (1 - s**r)**b.
    """
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold < 1 else 1, 1)
    for rows in range(2, most + 1):
        agree = threshold**rows
        bands = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-agree))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of every run of ``words`` words; a shorter text with a word has one, of all its words."""
    start, end, row = buffers.word_spans(data, offsets)
    h = buffers.word_hashes(data, start, end)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    code = np.zeros(max(len(h) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        code = code * buffers.STEP + h[k : k + len(code)]
    inside = row[: len(code)] == row[words - 1 :] if len(code) else np.zeros(0, dtype=bool)
    out, out_row = buffers.mixed(code[inside]), row[: len(code)][inside]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = np.array([_whole(h[first[r] : first[r] + n[r]]) for r in short], dtype=np.uint64)
        out, out_row = np.concatenate([out, buffers.mixed(whole)]), np.concatenate([out_row, short])
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return out, out_row


def _whole(h: np.ndarray) -> np.uint64:
    code = np.uint64(len(h))
    for x in h:
        code = np.uint64((int(code) * int(buffers.STEP) + int(x)) & ((1 << 64) - 1))
    return code


def sketches(data: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> dict[str, np.ndarray]:
    """Per row: two digests of its n-gram set, the set's size and its band hashes (0 rows of an empty set)."""
    h, row = shingles(data, offsets)
    n = len(offsets) - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    size = np.bincount(row, minlength=n)
    full = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[full]
    out = {"size": size, "d1": np.zeros(n, dtype=np.uint64), "d2": np.zeros(n, dtype=np.uint64), "bands": np.zeros((n, bands), dtype=np.uint64)}
    if not len(full):
        return out
    out["d1"][full] = buffers.mixed(np.add.reduceat(buffers.mixed(h ^ np.uint64(0xA5A5A5A5)), at) + size[full].astype(np.uint64))
    out["d2"][full] = np.add.reduceat(buffers.mixed(h + np.uint64(77)), at)
    low = h.astype(np.uint32)
    high = (h >> np.uint64(32)).astype(np.uint32)
    salts = np.random.default_rng(5).integers(1, 1 << 32, (bands * rows, 2), dtype=np.uint32) | np.uint32(1)
    scratch, other = np.empty_like(low), np.empty_like(low)
    for b in range(bands):
        code = np.full(len(full), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            np.multiply(low, salts[k, 0], out=scratch)
            np.multiply(high, salts[k, 1], out=other)
            np.add(scratch, other, out=scratch)
            np.bitwise_xor(scratch, scratch >> np.uint32(15), out=scratch)
            np.multiply(scratch, np.uint32(0x2C1B3C6D), out=scratch)
            code = buffers.mixed(code ^ np.minimum.reduceat(scratch, at).astype(np.uint64)) + np.uint64(k)
        out["bands"][full, b] = code
    return out


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketch_documents(docs: DataFrame, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, d1, d2, size, bands): what the join needs of every document, without its n-grams; ``th`` hashes the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.flat(batch.column(1))
            for a, b in buffers.chunks(offsets):
                part = offsets[a : b + 1]
                s = sketches(data[part[0] : part[-1]], part - part[0], bands, rows)
                counts = np.where(s["size"] > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(s["bands"][s["size"] > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(s["d1"].view(np.int64)), pa.array(s["d2"].view(np.int64)), pa.array(s["size"].astype(np.int64)), lists],
                    names=["id", "th", "d1", "d2", "size", "bands"],
                )

    raw = F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("raw")
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), raw, text_hash(text_col).alias("th"))
    return rows_in.mapInArrow(run, "id long, th long, d1 long, d2 long, size long, bands array<long>")


def ngram_sets(texts: DataFrame) -> DataFrame:
    """(id, d1, copies, grams) of rows (id, d1, copies, raw) whose text still has the digest; grams are sorted uint64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.flat(batch.column("raw"))
            for a, b in buffers.chunks(offsets):
                part = offsets[a : b + 1]
                text = data[part[0] : part[-1]]
                s = sketches(text, part - part[0], 0, 0)
                h, row = shingles(text, part - part[0])
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                grams = [np.unique(h[x:y]).tobytes() for x, y in zip(bounds, bounds[1:])]
                same = s["d1"].view(np.int64) == batch.column("d1").slice(a, b - a).to_numpy()
                out = pa.RecordBatch.from_arrays(
                    [batch.column("d1").slice(a, b - a), batch.column("copies").slice(a, b - a), pa.array(grams, pa.binary())], names=["id", "copies", "grams"]
                )
                yield out.filter(pa.array(same))

    return texts.mapInArrow(run, "id long, copies long, grams binary")


def jaccard_links(threshold: float):
    """Verifier: which sets of one block, or of two blocks, reach ``threshold``."""

    def verify(left: pa.Table, right: pa.Table | None) -> np.ndarray:
        a = [np.frombuffer(x, dtype=np.uint64) for x in left.column("grams").to_pylist()]
        b = a if right is None else [np.frombuffer(x, dtype=np.uint64) for x in right.column("grams").to_pylist()]
        na, nb = (np.array([len(x) for x in s], dtype=np.float64) for s in (a, b))
        if len(a) <= 2 and len(b) <= 2:
            shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.float64)
        else:
            every = a if right is None else a + b
            owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
            _, column, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
            rank = np.cumsum(seen > 1) - 1  # n-grams of one text only add nothing
            keep = seen[column] > 1
            owner, column = owner[keep], rank[column[keep]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            shared = np.zeros((len(a), len(b)), dtype=np.float64)
            width = int(column[-1]) + 1 if len(column) else 0
            for at in range(0, width, COLUMNS_AT_ONCE):
                x, y = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
                flags = np.zeros((len(every), min(COLUMNS_AT_ONCE, width - at)), dtype=np.float32)
                flags[owner[x:y], column[x:y] - at] = 1
                shared += flags[: len(a)] @ flags[len(every) - len(b) :].T
        union = na[:, None] + nb[None, :] - shared
        return shared / np.maximum(union, 1) >= threshold

    return verify


def near_classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """(id, th, copy_id, class_id, n_links, kept) of every document; see ``ngram_jaccard_join``."""
    bands, rows = band_plan(threshold, recall)
    sketch = materialise(sketch_documents(docs, bands, rows, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th")))
    classes = sketch.filter("size > 0").groupBy("d1", "d2").agg(
        first.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    classes = materialise(classes, "classes")
    members = classes.select(F.col("d1").alias("id"), F.col("size").alias("weight"), F.posexplode("bands").alias("band", "code"))
    members = members.select("id", "weight", F.xxhash64("band", "code").alias("bucket"))

    def payload(homes: DataFrame) -> DataFrame:
        wanted = classes.join(homes.select(F.col("id").alias("d1")), "d1").select("rep", "d1", "copies")
        raw = F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("raw")
        texts = docs.select(F.col(id_col).cast("long").alias("doc"), raw).join(wanted, F.col("doc").eqNullSafe(F.col("rep.id")))
        return ngram_sets(texts.select("d1", "copies", "raw"))

    found = linked_members(members, payload, jaccard_links(threshold), BLOCK_SHINGLES)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    placed = (
        classes.select("d1", "rep", "copies")
        .join(links.withColumnRenamed("id", "d1"), "d1", "left")
        .join(roots.withColumnRenamed("node", "d1"), "d1", "left")
        .withColumn("root", F.coalesce("root", "d1"))
    )
    placed = materialise(placed, "placed")
    names = placed.groupBy("root").agg(F.min("rep").alias("top"))
    placed = placed.join(names, "root").select(
        "d1", "top", F.col("rep.id").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("th").alias("th"))
    worded = sketch.filter("size > 0").select("id", "th", "d1").join(placed, "d1").drop("d1")
    wordless = sketch.filter("size = 0").select("id", "th", own.alias("top"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(wordless).select(
        "id", "th", "copy_id", F.col("top.id").alias("class_id"), "n_links", own.eqNullSafe(F.col("top")).alias("kept")
    )


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy_id, class_id, n_links, kept) of every document.

    Texts are lower-cased and split at ASCII white space; a text's set holds its
    runs of five words (all its words if there are fewer). Two documents link if
    the Jaccard similarity of their sets reaches ``threshold``. ``n_links`` counts
    the other documents linked directly, ``class_id`` is the smallest id reachable
    over links, ``copy_id`` the smallest id with an equal set, and ``kept`` marks
    the row with the smallest id of each class.

    Equal sets are collapsed to one member first. Bands of MinHash values, their
    number chosen for ``recall`` at the threshold, put members into buckets; the
    blocks that meet in a bucket are verified on full sets.

    A text without words links with nothing, not even with another one: it is a
    class of its own. Repeated ids are separate documents; among equal smallest
    ids the text hash decides, and repeated rows of the kept one are all marked.
    A null id is larger than any other. An empty table gives no rows; other
    columns are ignored.
    """
    return near_classes(docs, threshold, recall, id_col, text_col).drop("th").withColumnRenamed("id", id_col)


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per class of near copies: the kept one of ``ngram_jaccard_join``.

    Of repeated rows (equal id and text) of a kept document one stays. Texts
    without words all stay. The columns are those of ``docs``.
    """
    kept = near_classes(docs, threshold, recall, id_col, text_col).filter("kept")
    own, other, n, th = (unused(docs, c) for c in ("kept_id", "kept_text", "kept_rows", "text_hash"))
    counted = kept.groupBy(F.col("id").alias(own), F.col("th").alias(other)).agg(F.count(F.lit(1)).alias(n))
    tagged = docs.withColumn(th, text_hash(text_col))
    met = tagged.join(counted, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(th) == F.col(other)))
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    single = met.filter((F.col(n) == 1) | wordless)
    repeated = met.filter((F.col(n) > 1) & ~wordless).dropDuplicates([own, other])
    return single.unionByName(repeated).select(*docs.columns)
