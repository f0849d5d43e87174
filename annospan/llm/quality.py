"""Quality scores from gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospan.llm import buffers
from annospan.llm.tables import bounded_sample, crc_rest, text_bytes
from annospan.session import materialise

STATS = [
    "log_bytes", "log_words", "bytes_per_char", "letters", "capitals", "digits", "blanks", "marks", "exclaims", "bars",
    "symbols", "line_rate", "word_length", "word_spread", "short_words", "long_words", "marked_words", "repeats",
    "repeat_runs", "near_repeats", "capital_words", "symbol_words",
]
FIT_ROWS = 20_000
KEEP_AT = 0.3


def _class(text: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[list(text.encode())] = 1
    return table


CAPITALS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SMALL = _class("abcdefghijklmnopqrstuvwxyz")
DIGITS = _class("0123456789")
MARKS = _class(".,;:?'\"()-")
SYMBOLS = _class("#$%&*+/<=>@[\\]^_`{|}~")
EXCLAIMS, BARS, NEWLINES = _class("!"), _class("|"), _class("\n")
BLANKS = buffers.BLANK.astype(np.uint8)
LEADS = np.zeros(256, dtype=np.uint8)
LEADS[0xC0:] = 1
TAILS = np.zeros(256, dtype=np.uint8)
TAILS[0x80:0xC0] = 1


def row_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` per text of the buffer; shares are 0 for an empty text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    count = lambda table: buffers.per_span(table[data], offsets).astype(np.float64)
    per_byte = lambda x: x / np.maximum(size, 1)
    start, end, row = buffers.word_spans(data, offsets)
    words = np.bincount(row, minlength=n).astype(np.float64)
    per_word = lambda flags: buffers.per_row(flags, row, n) / np.maximum(words, 1)
    length = (end - start).astype(np.float64)
    mean = per_word(length)
    h = buffers.word_hashes(data, start, end)

    def equal_to(lag: int) -> np.ndarray:
        same = np.zeros(len(h), dtype=bool)
        if len(h) > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        return same

    before = equal_to(1)
    run = before & np.concatenate([[False], before[:-1]])[: len(before)]
    near = equal_to(2) | equal_to(3)
    last = data[end - 1] if len(end) else np.zeros(0, dtype=np.uint8)
    first = data[start] if len(start) else np.zeros(0, dtype=np.uint8)
    small = np.concatenate([[0], np.cumsum(SMALL[data], dtype=np.int64)])
    big = np.concatenate([[0], np.cumsum(CAPITALS[data], dtype=np.int64)])
    shouted = (big[end] - big[start] >= 2) & (small[end] == small[start])
    columns = [
        np.log1p(size), np.log1p(words), size / np.maximum(size - count(TAILS), 1),
        per_byte(count(CAPITALS) + count(SMALL) + count(LEADS)), per_byte(count(CAPITALS)), per_byte(count(DIGITS)),
        per_byte(count(BLANKS)), per_byte(count(MARKS)), per_byte(count(EXCLAIMS)), per_byte(count(BARS)),
        per_byte(count(SYMBOLS)), per_byte(count(NEWLINES)),
        mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length <= 3), per_word(length >= 12),
        per_word(MARKS[last] + EXCLAIMS[last]), per_word(before), per_word(run), per_word(near), per_word(shouted),
        per_word(SYMBOLS[last] | SYMBOLS[first]),
    ]
    return np.column_stack(columns).reshape(n, len(STATS))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[str] = ()) -> DataFrame:
    """(id, *STATS, *extra): statistics of every whole text; null counts as empty. ``extra`` columns are doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.flat(batch.column(1))
            for a, b in buffers.chunks(offsets):
                part = offsets[a : b + 1]
                stats = row_statistics(data[part[0] : part[-1]], part - part[0])
                columns = [batch.column(0).slice(a, b - a), *(pa.array(c) for c in stats.T)]
                columns += [batch.column(c).slice(a, b - a) for c in extra]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *STATS, *extra])

    schema = ", ".join(["id long", *(f"{c} double" for c in (*STATS, *extra))])
    raw = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"), *[F.col(c).cast("double").alias(c) for c in extra])
    return raw.mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of equal depth: arrays (tree, node) and (tree, leaf)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x) == 0:
            return out
        row = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    least: float = 2.0, shrink: float = 1.0,
) -> Trees:
    """Histogram boosting with the logistic loss.

    Values are binned at quantiles once; each level sums gradients by (node,
    feature, bin) and takes the cut of the largest gain. A node without a gain
    sends everything to the left. No rows, or one class only, gives the prior.
    """
    n, width = x.shape if x.ndim == 2 else (0, len(STATS))
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((trees, inner), dtype=np.int64)
    cut = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature, cut, value)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin, row = np.full(n, base), np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * bins + code[:, f]
                g = np.bincount(cell, grad, many * bins).reshape(many, bins)
                h = np.bincount(cell, hess, many * bins).reshape(many, bins)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + shrink) + (gt - gl) ** 2 / (ht - hl + shrink) - gt**2 / (ht + shrink)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(e):] = 0
                at = gain.argmax(1)
                top = gain[np.arange(many), at]
                better = np.flatnonzero(top > best + 1e-9)
                best[better] = top[better]
                feature[t, first + better] = f
                cut[t, first + better] = e[at[better]]
            node = 2 * node + 1 + (x[row, feature[t, node]] > cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value[t] = -rate * g / (h + shrink)
        margin += value[t][leaf]
    return Trees(base, feature, cut, value)


def labelled(stats: DataFrame, labels: DataFrame, label: str, modulus: int, id_col: str, rows: int) -> DataFrame:
    """Statistics with their label for the rows that may be learned from, at most ``rows``.

    Rows whose id has remainder 0 are held out. Contradicting labels of one id
    count once, as their mean.
    """
    known = labels.filter(F.col(label).isNotNull() & (crc_rest(id_col, modulus) != 0))
    known = known.groupBy(id_col).agg(F.avg(label).alias("label"))
    return bounded_sample(stats.join(known, id_col), [id_col], rows)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    keep_at: float = KEEP_AT,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(id, held_out, score, predicted) for every document.

    ``score`` is the probability of label 1 by boosted trees over the statistics
    of the whole text; ``predicted`` is 1 from ``keep_at`` on. The trees are
    fitted on a bounded sample (``fit_rows``) of the labelled rows that are not
    held out; every row is scored. Null and empty texts have the statistics of an
    empty text; null ids are scored but never learned from; repeated rows each
    get a score; an empty table gives no rows, a missing label the prior.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "quality-stats")
    sample = labelled(stats, labels, label_col, modulus, id_col, fit_rows).select("label", *STATS).toPandas()
    model = fit_trees(sample[STATS].to_numpy(np.float64), sample["label"].to_numpy(np.float64) >= 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in STATS]).reshape(batch.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.probability(x))], names=["id", "score"])

    scored = stats.withColumnRenamed(id_col, "id").mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), (crc_rest("id", modulus) == 0).alias("held_out"), "score",
        (F.col("score") >= keep_at).cast("int").alias("predicted"),
    )


def keep_quality(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    keep_at: float = KEEP_AT,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs`` without the rows whose score (see ``score_quality``) is below ``keep_at``.

    Rows are scored in place, so no text is moved: the fit joins a bounded,
    broadcast sample of labelled ids, the filter is one expression over the text.
    Null and empty texts are judged by the statistics of an empty text; labels
    that are missing or all alike reject nothing unless the prior does.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (crc_rest(id_col, modulus) != 0))
    known = bounded_sample(known.groupBy(id_col).agg(F.avg(label_col).alias("label")), [id_col], fit_rows)
    found = docs.select(id_col, text_col).join(F.broadcast(known), id_col)
    stats = document_statistics(found.select(F.xxhash64(id_col, text_col).alias("row"), "label", F.col(text_col)), "row", text_col, ["label"])
    sample = bounded_sample(stats, ["row"], fit_rows).toPandas().sort_values("row")
    model = fit_trees(sample[STATS].to_numpy(np.float64), sample["label"].to_numpy(np.float64) >= 0.5)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raw in batches:
            data, offsets = buffers.flat(raw)
            parts = [np.zeros(0)]
            for a, b in buffers.chunks(offsets):
                part = offsets[a : b + 1]
                parts.append(model.probability(row_statistics(data[part[0] : part[-1]], part - part[0])))
            yield pa.array(np.concatenate(parts))

    scored = F.arrow_udf(score, "double")
    return docs.filter(scored(text_bytes(text_col)) >= keep_at)
