"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospan.llm.tables import bounded_sample, crc_rest, unused

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)
BUCKET_BITS = 20
COUNTS = (1, 2, 3)
SHARES = (1 / 400, 1 / 150, 1 / 50)
LEVELS = len(COUNTS) + len(SHARES)
FIT_ROWS = 2_500
FIT_CHARS = 20_000
FEATURES = 2_048
GRADES = 3
REJECT_AT = 0.5


def buckets_of(word: str) -> tuple[int, ...]:
    """Hash buckets of the word and of its leading letters, so that unseen endings still count."""
    forms = [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]
    return tuple(zlib.crc32(f.encode()) & ((1 << BUCKET_BITS) - 1) for f in forms)


class Buckets(dict):
    """Buckets of each word that are in ``used`` (all without it). Filled on demand, bounded."""

    def __init__(self, used: frozenset[int] | None = None, most: int = 300_000):
        super().__init__()
        self.used, self.most = used, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.most:
            self.clear()
        found = buckets_of(word)
        self[word] = found = found if self.used is None else tuple(b for b in found if b in self.used)
        return found

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """Occurrences per bucket and the number of words of the text."""
        words = WORD.findall(text.lower())
        out: dict[int, int] = {}
        for word, n in Counter(words).items():
            for b in self[word]:
                out[b] = out.get(b, 0) + n
        return out, len(words)


def levels(count: int, words: int) -> list[int]:
    """The levels a bucket reaches: occurrences and share of the words, each in three steps."""
    share = count / max(words, 1)
    return [i for i, least in enumerate((*COUNTS, *SHARES)) if (count if i < len(COUNTS) else share) >= least]


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]) with one weight vector.

    ``weights`` maps a bucket to the weight of having reached each of its levels.
    """

    weights: dict[int, np.ndarray]
    thresholds: np.ndarray

    def score(self, text: str, buckets: Buckets) -> float:
        counts, words = buckets.counts(text)
        return float(sum(self.weights[b][levels(n, words)].sum() for b, n in sorted(counts.items())))

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of grade 1 or more, 2 or more ... for each score."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[:, None] - self.thresholds, -40, 40)))


def chi_square(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Association of features held by ``a`` of ``n1`` toxic and ``b`` of ``n0`` clean texts, 0 where clean texts hold more."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    chi = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum((a + b) * (n0 + n1 - a - b) * n1 * n0, 1)
    return np.where(a * n0 > b * n1, chi, 0)


def select_buckets(texts: list[str], toxic: np.ndarray, most: int) -> frozenset[int]:
    """Buckets that toxic texts hold far more often than clean ones, once or repeatedly.

    A bucket must pass the chi-square value that chance would reach once among
    all buckets tried (``2 ln n``); of those at most ``most`` are kept.
    """
    held = np.zeros((2, 2, 1 << BUCKET_BITS), dtype=np.int32)
    every = Buckets()
    for text, y in zip(texts, toxic):
        counts, _ = every.counts(text)
        found = np.fromiter(counts, dtype=np.int64, count=len(counts))
        twice = found[np.fromiter(counts.values(), dtype=np.int64, count=len(counts)) > 1]
        held[int(y), 0, found] += 1
        held[int(y), 1, twice] += 1
    n1 = int(toxic.sum())
    chi = chi_square(held[1], held[0], n1, len(texts) - n1).max(axis=0)
    least = 2 * np.log(np.count_nonzero(held.sum(axis=(0, 1))) + 1)
    best = np.argsort(-chi, kind="stable")[:most]
    return frozenset(int(b) for b in best[chi[best] >= least])


def severity_grades(density: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grade 0 for clean texts, 1 to 3 for toxic ones by thirds of their share of toxic words.

    The labels only say whether a text is toxic; the order among toxic texts is
    how dense the buckets are that the labels single out.
    """
    grades = np.zeros(len(toxic), dtype=np.int64)
    hit = np.flatnonzero(toxic)
    if len(hit):
        cuts = np.quantile(density[hit], [k / GRADES for k in range(1, GRADES)])
        grades[hit] = 1 + np.searchsorted(cuts, density[hit], side="right")
    return grades


def fit_ordinal(texts: list[str], toxic: np.ndarray, most: int = FEATURES, steps: int = 500, ridge: float = 1e-4) -> OrdinalModel:
    """Cumulative-link model by projected Adam; ordered thresholds from positive gaps.

    Weights are never negative: cues only ever add. Both classes weigh the same.
    Without both classes nothing is called toxic.
    """
    toxic = np.asarray(toxic, dtype=bool)
    if toxic.sum() == 0 or toxic.all():
        return OrdinalModel({}, np.full(GRADES, 40.0))
    used = select_buckets(texts, toxic, most)
    number = {b: i for i, b in enumerate(sorted(used))}
    buckets = Buckets(used)
    pairs, density = [], np.zeros(len(texts))
    for r, text in enumerate(texts):
        counts, words = buckets.counts(text)
        pairs += [(r, number[b] * LEVELS + k) for b, n in counts.items() for k in levels(n, words)]
        density[r] = max(counts.values(), default=0) / max(words, 1)
    row, col = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    n, width = len(texts), len(number) * LEVELS
    grades = severity_grades(density, toxic)
    weight_of = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    above = (grades[:, None] >= np.arange(1, GRADES + 1)).astype(np.float64)
    theta = np.concatenate([np.zeros(width), [2.0], np.zeros(GRADES - 1)])  # weights, first threshold, log gaps
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:width], np.exp(np.clip(theta[width + 1 :], -5, 3))
        cuts = theta[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n)[:, None] - cuts, -40, 40)))
        slope = (p - above) * weight_of[:, None]
        tail = [-slope[:, k:].sum() * (gaps[k - 1] if k else 1.0) for k in range(GRADES)]
        grad = np.concatenate([np.bincount(col, slope.sum(1)[row], width) + ridge * w, tail])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (1 - 0.8 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        theta[:width] = np.maximum(theta[:width], 0)
    cuts = theta[width] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(theta[width + 1 :], -5, 3)))])
    by_bucket = theta[:width].reshape(-1, LEVELS)
    return OrdinalModel({b: by_bucket[i] for b, i in number.items() if by_bucket[i].max() > 1e-3}, cuts)


def fit_on_labels(docs: DataFrame, labels: DataFrame, modulus: int, fit_rows: int, id_col: str, text_col: str, label_col: str, fit_chars: int) -> OrdinalModel:
    """Fit on at most ``fit_rows`` texts of either label, not held out; ``fit_chars`` bounds a text that goes to the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & (crc_rest(id_col, modulus) != 0))
    known = known.groupBy(id_col).agg((F.avg(label_col) >= 0.5).alias("toxic"))
    # two bounded samples: small enough to broadcast whatever the table's size
    ids = bounded_sample(known.filter("toxic"), [id_col], fit_rows).unionByName(bounded_sample(known.filter("not toxic"), [id_col], fit_rows))
    found = docs.select(id_col, text_col).filter(F.length(text_col) <= fit_chars).join(F.broadcast(ids), id_col).select("toxic", F.col(text_col).alias("text"))
    distinct = found.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies would pass off chance words as evidence
    rows = bounded_sample(distinct, ["text"], 2 * fit_rows).toPandas().sort_values("text")
    return fit_ordinal(rows["text"].tolist(), rows["toxic"].to_numpy(bool))


def cue_weight(model: OrdinalModel):
    """Column function: the weighted sum of a text's cues, 0 for null and empty texts."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets(frozenset(model.weights))
        for texts in batches:
            yield pa.array([model.score(t, buckets) if t else 0.0 for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    reject_at: float = REJECT_AT,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """``docs`` plus severity (0 to 3), grade, p_toxic and rejected.

    A text's features are the hashed words and word beginnings it holds, by number
    and by share; one weighted sum is held against the ordered thresholds of the grades. ``severity`` is the expected
    grade, ``grade`` the number of thresholds passed with even odds, ``p_toxic``
    the probability of grade 1 or more and ``rejected`` says that it reaches
    ``reject_at``. The model is fitted on a bounded sample of labelled rows: at most
    ``fit_rows`` texts of either label, of at most ``fit_chars`` characters each (longer
    ones are scored whole but not learned from); rows whose id's crc32 has
    remainder 0 are held out of it.

    Null and empty texts have no features and are kept; repeated rows are scored
    alike; an empty table gives no rows; without labels nothing is rejected.
    Columns of ``docs`` called like a result are replaced.
    """
    model = fit_on_labels(docs, labels, modulus, fit_rows, id_col, text_col, label_col, fit_chars)
    cut = [float(c) for c in model.thresholds]
    cue = unused(docs, "_cue")
    p = lambda k: 1 / (1 + F.exp(F.lit(cut[k]) - F.col(cue)))
    scored = docs.withColumn(cue, cue_weight(model)(F.col(text_col)))
    return scored.withColumns(
        {
            "severity": sum((p(k) for k in range(1, GRADES)), p(0)),
            "grade": sum(((F.col(cue) >= c).cast("int") for c in cut[1:]), (F.col(cue) >= cut[0]).cast("int")),
            "p_toxic": p(0),
            "rejected": p(0) >= reject_at,
        }
    ).drop(cue)


def keep_harmless(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    reject_at: float = REJECT_AT,
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` rejects; columns of any name stay as they are.

    Null and empty texts stay; repeated rows stay or go together; an empty table
    gives no rows; without labels nothing goes.
    """
    model = fit_on_labels(docs, labels, modulus, fit_rows, id_col, text_col, label_col, fit_chars)
    p_toxic = 1 / (1 + F.exp(F.lit(float(model.thresholds[0])) - cue_weight(model)(F.col(text_col))))
    return docs.filter(p_toxic < reject_at)
