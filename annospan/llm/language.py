"""Language identification by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospan.llm import buffers
from annospan.llm.tables import crc_rest, hash_share

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
FIT_ROWS = 2_400
LANGUAGES = 256
UNKNOWN = "und"
WINDOWS_AT_ONCE = 1024


@dataclass(frozen=True)
class ByteNet:
    """Filters per width (width, 256, FILTERS), their biases, and the softmax layer."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray


def window_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of the windows that cover every byte of every row.

    The last window of a row of at least one window ends with the row; a shorter
    row is one window that is padded behind its end.
    """
    size = np.diff(offsets)
    n = np.maximum(-(-size // WINDOW), 1)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(nth * WINDOW, np.maximum(size[row] - WINDOW, 0)) + offsets[:-1][row]
    return start, row


def window_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of each window; positions at or behind ``end`` are blanks."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    if not len(data):
        return np.full(at.shape, 32, dtype=np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(32))


def pooled(net: ByteNet, x: np.ndarray, with_place: bool = False):
    """Largest response of every filter in each window (and where it was)."""
    out, places = [], []
    for width in WIDTHS:
        w = net.filters[width]
        n = x.shape[1] - width + 1
        y = w[0][x[:, :n]]
        for j in range(1, width):
            y += w[j][x[:, j : j + n]]
        if with_place:
            at = y.argmax(axis=1)
            places.append(at)
            out.append(np.take_along_axis(y, at[:, None, :], axis=1)[:, 0, :] + net.biases[width])
        else:
            out.append(y.max(axis=1) + net.biases[width])
    return (np.hstack(out), places) if with_place else np.hstack(out)


class PairTables:
    """The same filters as sums over byte pairs: one lookup for two positions."""

    def __init__(self, net: ByteNet):
        first, second = np.divmod(np.arange(65536), 256)
        pair = lambda w, j: w[j][first] + w[j + 1][second]
        w2, w3, w4 = (net.filters[k] for k in WIDTHS)
        self.net = net
        self.pairs = np.hstack([pair(w2, 0), pair(w3, 0), pair(w4, 0), pair(w4, 2)]).astype(np.float32)
        self.third = w3[2].astype(np.float32)
        self.bias = np.hstack([net.biases[k] for k in WIDTHS])

    def pooled(self, x: np.ndarray) -> np.ndarray:
        code = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        y = self.pairs[code]
        f = FILTERS
        two = y[:, :, :f].max(axis=1)
        three = (y[:, :-1, f : 2 * f] + self.third[x[:, 2:]]).max(axis=1)
        four = (y[:, :-2, 2 * f : 3 * f] + y[:, 2:, 3 * f :]).max(axis=1)
        return np.hstack([two, three, four]) + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: ByteNet, hidden: np.ndarray) -> np.ndarray:
    return softmax(np.maximum(hidden, 0) @ net.dense + net.bias)


def fit_network(windows: np.ndarray, target: np.ndarray, langs: list[str], epochs: int = 30, batch: int = 64, rate: float = 0.02) -> ByteNet:
    """Adam on the cross entropy, classes weighted by the root of their rarity.

    The gradient of a pooled filter reaches only the bytes of its largest response.
    """
    rng = np.random.default_rng(17)
    hidden = FILTERS * len(WIDTHS)
    params = {f"w{k}": rng.normal(0, 0.1, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS}
    params |= {f"b{k}": np.zeros(FILTERS, dtype=np.float32) for k in WIDTHS}
    params |= {"dense": rng.normal(0, 0.3, (hidden, len(langs))).astype(np.float32), "bias": np.zeros(len(langs), dtype=np.float32)}
    net = lambda: ByteNet(langs, {k: params[f"w{k}"] for k in WIDTHS}, {k: params[f"b{k}"] for k in WIDTHS}, params["dense"], params["bias"])
    if len(windows) == 0 or len(langs) < 2:
        return net()
    share = np.bincount(target, minlength=len(langs)) / len(target)
    class_weight = (1 / np.sqrt(np.maximum(share, 1e-9))).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows].astype(np.int64), target[rows]
            raw, places = pooled(net(), x, with_place=True)
            act = np.maximum(raw, 0)
            p = softmax(act @ params["dense"] + params["bias"])
            p[np.arange(len(rows)), y] -= 1
            p *= (class_weight[y] / class_weight[y].sum())[:, None]
            grads = {"dense": act.T @ p, "bias": p.sum(0)}
            back = (p @ params["dense"].T) * (raw > 0)
            for i, width in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[f"b{width}"] = g.sum(0)
                gw = np.zeros_like(params[f"w{width}"])
                col = np.broadcast_to(np.arange(FILTERS), g.shape)
                for j in range(width):
                    np.add.at(gw[j], (np.take_along_axis(x, places[i] + j, axis=1), col), g)
                grads[f"w{width}"] = gw
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net()


def training_windows(docs: DataFrame, modulus: int, held: int, fit_rows: int, id_col: str, text_col: str, lang_col: str):
    """One window at a hashed place of at most ``fit_rows`` texts, the same number per language at most."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (crc_rest(id_col, modulus) != held))
    sizes = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()
    if not sizes:
        return np.zeros((0, WINDOW), dtype=np.uint8), np.zeros(0, dtype=np.int64), []
    langs = sorted(r[lang_col] for r in sizes)
    each = max(1, fit_rows // len(langs))
    share = F.create_map(*[c for r in sizes for c in (F.lit(r[lang_col]), F.lit(each / r["count"]))])
    place = F.floor(hash_share(id_col, lang_col) * 7919 % 1 * F.greatest(F.lit(0), F.length(text_col) - WINDOW // 2)).cast("int")
    drawn = known.filter(hash_share(id_col, lang_col) < F.try_element_at(share, F.col(lang_col)))
    crops = drawn.select(
        F.col(lang_col).alias("lang"), F.substr(F.col(text_col), place + 1, F.lit(WINDOW)).cast("binary").alias("raw"),
        hash_share(id_col, lang_col).alias("h"),
    )
    rows = crops.orderBy("h", "raw").limit(2 * fit_rows).toPandas()
    raws = [bytes(r)[:WINDOW].ljust(WINDOW) for r in rows["raw"]]
    windows = np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(-1, WINDOW)
    return windows, np.searchsorted(langs, rows["lang"].to_numpy(dtype=str)).astype(np.int64), langs


def identify_languages(
    docs: DataFrame, modulus: int = 4, held: int = 2, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, held_out, lang_pred, score) for every document.

    The UTF-8 bytes of the whole text are cut into windows of ``WINDOW`` bytes.
    Filters of widths 2, 3 and 4 run over each, their largest responses go through
    a softmax, and a text's score is the mean probability over its windows.
    Filters are applied as lookups of byte pairs over whole Arrow batches.

    The network is fitted on one window of at most about ``fit_rows`` texts whose
    id is not held out and whose language is known. A null text or one without a
    letter is ``und`` with score 0; so is every text if no language is known. With
    one known language its score is 1. Repeated rows are predicted alike; an empty
    table gives no rows; other columns are ignored.
    """
    windows, target, langs = training_windows(docs, modulus, held, fit_rows, id_col, text_col, lang_col)
    net = fit_network(windows, target, langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = PairTables(net)
        for batch in batches:
            data, offsets = buffers.flat(batch.column(1))
            for a, b in buffers.chunks(offsets):
                part = offsets[a : b + 1]
                text = data[part[0] : part[-1]]
                start, row = window_starts(part - part[0])
                end = (part - part[0])[1:][row]
                total = np.zeros((b - a, len(langs)))
                for k in range(0, len(start), WINDOWS_AT_ONCE):
                    sel = slice(k, k + WINDOWS_AT_ONCE)
                    p = probabilities(net, tables.pooled(window_bytes(text, start[sel], end[sel])))
                    np.add.at(total, row[sel], p)
                mean = total / np.bincount(row, minlength=b - a)[:, None]
                lettered = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                best = mean.argmax(axis=1)
                names = pa.array(np.where(lettered, np.array(langs)[best], UNKNOWN), pa.string())
                score = np.where(lettered, mean[np.arange(b - a), best], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), names, pa.array(score)], names=["id", "lang_pred", "score"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("raw"), text.rlike(r"\p{L}").alias("lettered"))
    if langs:
        found = raw.mapInArrow(run, "id long, lang_pred string, score double")
    else:
        found = raw.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return found.select(F.col("id").alias(id_col), (crc_rest("id", modulus) == held).alias("held_out"), "lang_pred", F.least("score", F.lit(1.0)).alias("score"))
