"""Small tables with every odd case, and brute-force versions of the joins."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, score string, raw string"
WORDS = {
    "en": "the of and that with house river stone over under walking table morning".split(),
    "de": "der die und mit haus fluss stein über unter gehen tisch morgen größe".split(),
    "fr": "le la et avec maison rivière pierre sur sous marcher été matin où".split(),
}


def text(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "er"]) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with ids 0..n-1, then empty, blank, symbol-only, very long, repeated and null-id rows."""
    rng = random.Random(seed)
    base = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        base.append((i, text(rng, lang, rng.randint(1, 80)), lang, rng.choice(["a", "b", "c", None])))
    odd = [
        (n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \n\t ", "de", "b"), (n + 3, "### 123 !!", "en", "b"),
        (n + 4, text(rng, "en", 30_000), "en", "c"), (n + 5, base[0][1], "en", "a"), base[1], base[1], (None, base[2][1], "fr", "a"),
    ]
    return [(i, t, lang, s, 0, "x", "y", "z", "w") for i, t, lang, s in base + odd]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCUMENTS)


def ngrams(t: str | None, n: int = 5) -> frozenset:
    w = (t or "").lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def classes(n: int, linked) -> list[int]:
    """Smallest row number reachable for each of ``n`` rows."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in linked[i]:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def brute_classes(texts: dict, threshold: float = 0.8) -> dict:
    """Smallest id reachable over n-gram links, for each id."""
    ids = sorted(texts)
    sets = [ngrams(texts[i]) for i in ids]
    linked = [[] for _ in ids]
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) / len(x | y) >= threshold:
                linked[a].append(b)
                linked[b].append(a)
    root = classes(len(ids), linked)
    return {i: ids[root[k]] for k, i in enumerate(ids)}
