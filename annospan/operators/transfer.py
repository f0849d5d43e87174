"""Annotation transfer between paired entities and its blind evaluation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from annospan.functions.cells import missing, strip_db_prefix
from annospan.functions.spans import length_ratio
from annospan.functions.text_similarity import char_tokens, scored_symbols, symbol_stem
from annospan.functions.tiers import confidence_tier
from annospan.operators.blocks import prefix_candidates
from annospan.operators.common import attach, union_all
from annospan.operators.ordered import draw_hash, draw_int, hash_bucket, ordered_scan, row_number, with_iterations
from annospan.operators.permutation import coded, permute
from annospan.session import materialise, spread

UNIT = 10_000
HELD_VALUES = 2_000_000  # largest group of a bootstrap that a task holds, 16 MB
HELD_ITERATIONS = 20  # iterations of a group in one row


def score_pairs(left: DataFrame, right: DataFrame, cut: float = 1.0) -> DataFrame:
    """Candidate pairs with a score of at least ``cut`` (accession, gene, grp, length, cluster).

    score = 3 same cluster + 2.5 symbol similarity + 1 same group + 0.5 length
    ratio. A pair can only reach the cut by sharing a cluster, a group or a
    symbol stem, or by enough symbol similarity; each case is an equi join (the
    last one on the rarest characters), so no full product is formed.
    """
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in ("accession", "gene", "grp", "length", "cluster")])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in ("accession", "gene", "grp", "length", "cluster")])
    sym = lambda c: F.upper(F.trim(F.col(c)))
    stem = lambda c: symbol_stem(sym(c))

    symbols_a = a.filter(~missing("a_gene")).select(sym("a_gene").alias("sa")).distinct()
    symbols_b = b.filter(~missing("b_gene")).select(sym("b_gene").alias("sb")).distinct()
    min_ratio = max((cut - 0.5) / 2.5, 1e-6)
    by_stem = symbols_a.withColumn("k", stem("sa")).filter("k <> ''").join(symbols_b.withColumn("k", stem("sb")), "k").select("sa", "sb")
    by_chars = prefix_candidates(
        symbols_a.withColumn("t", char_tokens(F.col("sa"))), "sa", "t",
        symbols_b.withColumn("t", char_tokens(F.col("sb"))), "sb", "t", max(min_ratio - 1e-4, 1e-6),
    )
    equal = symbols_a.join(symbols_b, F.col("sa") == F.col("sb"))
    near = materialise(scored_symbols(union_all([by_stem, by_chars, equal]).distinct(), "sa", "sb", "gene_similarity"), "symbols")
    alike = near.filter(F.col("gene_similarity") >= min_ratio - 1e-4).select("sa", "sb")

    ka, kb = a.withColumn("sa", sym("a_gene")), b.withColumn("sb", sym("b_gene"))
    ids = ["a_accession", "b_accession"]
    known = F.col("a_grp").isNotNull() & ~F.col("a_grp").isin("other", "")
    found = union_all([
        a.filter(~missing("a_cluster")).join(b, F.col("a_cluster") == F.col("b_cluster")).select(*ids),
        a.filter(known).join(b, F.col("a_grp") == F.col("b_grp")).select(*ids),
        ka.join(alike, "sa").join(kb, "sb").select(*ids),
    ]).distinct()
    full = materialise(found.join(ka, "a_accession").join(kb, "b_accession"), "candidates")
    # pairs found by cluster or group only: each distinct pair of symbols is scored once
    other = full.select("sa", "sb").distinct().join(near, ["sa", "sb"], "left_anti")
    scores = near.unionByName(scored_symbols(other, "sa", "sb", "gene_similarity"))
    same = F.col("sa").eqNullSafe(F.col("xa")) & F.col("sb").eqNullSafe(F.col("xb"))
    full = full.join(scores.withColumnsRenamed({"sa": "xa", "sb": "xb"}), same).drop("sa", "sb", "xa", "xb")
    same_cluster = F.coalesce((F.col("a_cluster") == F.col("b_cluster")) & ~missing("a_cluster"), F.lit(False))
    same_group = F.coalesce((F.col("a_grp") == F.col("b_grp")) & known, F.lit(False))
    ratio = length_ratio(F.col("a_length"), F.col("b_length"))
    flagged = full.withColumns({"same_cluster": same_cluster, "same_group": same_group, "length_ratio": ratio})
    score = (
        F.col("same_cluster").cast("double") * 3.0 + F.col("gene_similarity") * 2.5
        + F.col("same_group").cast("double") + F.coalesce("length_ratio", F.lit(0.0)) * 0.5
    )
    tier = confidence_tier(F.col("same_cluster"), F.col("gene_similarity") == 1.0, F.col("same_group"), F.col("gene_similarity"))
    return flagged.withColumn("candidate_score", score).filter(F.col("candidate_score") >= cut).withColumn("confidence_tier", tier)


def ortholog_type(df: DataFrame, left: str, right: str) -> DataFrame:
    """one2one; left repeated -> one2many; right repeated -> many2one (wins)."""
    nl = df.groupBy(left).agg(F.count(F.lit(1)).alias("__l"))
    nr = df.groupBy(right).agg(F.count(F.lit(1)).alias("__r"))
    kind = F.when(F.col("__r") > 1, "many2one").when(F.col("__l") > 1, "one2many").otherwise("one2one")
    return df.join(nl, left).join(nr, right).withColumn("ortholog_type", kind).drop("__l", "__r")


def stratified_split(df: DataFrame, by: str, key: Column, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: per tier ``max(1, round(n f))`` test rows by digest; single-row tiers calibrate.

    Tables with fewer than five rows are marked ``both``.
    """
    marked = df.withColumn("__h", F.concat(draw_hash(F.lit(seed), key), key.cast("string")))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    numbered = ordered_scan(marked, [by], hash_bucket("__h"), ["__h"], __k=row_number())
    need = F.greatest(F.bround(F.col("__n") * fraction), F.lit(1))
    split = (
        F.when(F.col("__total") < 5, "both")
        .when((F.col("__n") >= 2) & (F.col("__k") <= need), "test").otherwise("calibration")
    )
    return attach(numbered.join(sizes, by), total).withColumn("split", split).drop("__h", "__n", "__k", "__total")


def split_summary(df: DataFrame, tier: str) -> DataFrame:
    return df.groupBy(tier, "split").agg(F.count(F.lit(1)).alias("n_pairs"))


PREDICTION = ["target", "source", "method", "annotation_category", "term_value", "transfer_confidence"]


def transfer_direct(pairs: DataFrame, ann: DataFrame) -> DataFrame:
    """All annotations of the paired source. pairs: source, target; ann: source, category, term."""
    return pairs.select("source", "target").join(ann, "source").select(
        "target", "source", F.lit("A_direct_ortholog").alias("method"), "annotation_category", "term_value",
        F.lit("high").alias("transfer_confidence"),
    )


def architecture_overlap(pairs: DataFrame, left: DataFrame, right: DataFrame | None) -> DataFrame:
    """(source, target, shared, jaccard) of type sets, prefixes removed; counts, not collected sets.

    Without target data the source architecture stands in for it.
    """
    keys = pairs.select("source", "target").distinct()
    ls = left.select("source", strip_db_prefix("domain").alias("d")).distinct()
    if right is None:
        n = ls.groupBy("source").agg(F.count(F.lit(1)).alias("shared"))
        out = keys.join(n, "source", "left").fillna(0, ["shared"])
        return out.withColumn("architecture_jaccard", F.when(F.col("shared") > 0, 1.0).otherwise(0.0))
    rs = right.select("target", strip_db_prefix("domain").alias("d")).distinct()
    both = (
        keys.join(ls, "source").withColumn("s", F.lit(1)).unionByName(keys.join(rs, "target").withColumn("s", F.lit(2)))
        .groupBy("source", "target", "d").agg(F.sum("s").alias("s"))
        .groupBy("source", "target").agg(F.sum((F.col("s") == 3).cast("long")).alias("shared"), F.count(F.lit(1)).alias("u"))
    )
    out = keys.join(both, ["source", "target"], "left").fillna(0, ["shared", "u"])
    return out.select(
        "source", "target", "shared",
        F.when(F.col("u") == 0, 0.0).otherwise(F.round(F.col("shared") / F.col("u"), 4)).alias("architecture_jaccard"),
    )


def transfer_architecture(pairs: DataFrame, ann: DataFrame, left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Type annotations always, others only with shared architecture; confidence and score."""
    mode = "PROXY" if right is None else "FULL"
    arch = architecture_overlap(pairs, left, right)
    is_type = F.col("annotation_category") == "domain_type"
    rows = pairs.select("source", "target").join(arch, ["source", "target"]).join(ann, "source").filter(is_type | (F.col("shared") > 0))
    return rows.select(
        "target", "source", F.lit("B_domain_architecture").alias("method"), "annotation_category", "term_value",
        F.when(is_type, "high").otherwise("medium" if right is not None else "medium_proxy").alias("transfer_confidence"),
        F.col("shared").alias("shared_domain_count"), "architecture_jaccard", F.lit(mode).alias("architecture_mode"),
        F.round(F.col("architecture_jaccard") * F.when(is_type, 1.0).otherwise(0.7), 4).alias("architecture_score"),
    )


def transfer_cluster(members: DataFrame, ann: DataFrame, source: str = "human", target: str = "mouse") -> DataFrame:
    """Annotations of the first source member of the target's cluster.

    members: accession, species, cluster, position (input order).
    """
    first = members.filter(F.col("species") == source).groupBy("cluster").agg(F.min_by("accession", "position").alias("source"))
    hit = members.filter(F.col("species") == target).join(first, "cluster").select(F.col("accession").alias("target"), "source")
    return hit.join(ann, "source").select(
        "target", "source", F.lit("C_nearest_sequence").alias("method"), "annotation_category", "term_value",
        F.lit("sequence_based").alias("transfer_confidence"),
    )


def prediction_stats(pred: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Method x category counts."""
    return pred.groupBy("method").pivot("annotation_category", list(categories)).count().fillna(0)


def architecture_stats(pred: DataFrame) -> DataFrame:
    """(architecture_mode, n, mean, median, min, max) of the Jaccard of architecture predictions."""
    j = F.col("architecture_jaccard")
    return pred.filter(j.isNotNull()).groupBy("architecture_mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(j), 3).alias("mean_jaccard"), F.round(F.median(j), 3).alias("median_jaccard"),
        F.round(F.min(j), 3).alias("min_jaccard"), F.round(F.max(j), 3).alias("max_jaccard"),
    )


def match_sets(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every gold or predicted key with its status TP / FN / FP."""
    g = gold.select(*keys).distinct().withColumn("__g", F.lit(True))
    p = pred.select(*keys).distinct().withColumn("__p", F.lit(True))
    status = F.when(F.col("__g") & F.col("__p"), "TP").when(F.col("__g"), "FN").otherwise("FP")
    return g.join(p, list(keys), "full").withColumn("status", status).drop("__g", "__p")


def prf_columns(tp: Column, n_pred: Column, n_gold: Column, empty: float, digits: int = 4) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard; ``empty`` is the value when both sets are empty."""
    none = (n_pred == 0) & (n_gold == 0)
    p = F.when(n_pred > 0, tp / n_pred).otherwise(0.0)
    r = F.when(n_gold > 0, tp / n_gold).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * p * r / (p + r)).otherwise(0.0)
    j = F.when(n_pred + n_gold - tp > 0, tp / (n_pred + n_gold - tp)).otherwise(0.0)
    rows = {"precision": p, "recall": r, "f1": f1, "jaccard": j}
    return {k: F.when(none, F.lit(empty)).otherwise(F.round(v, digits)) for k, v in rows.items()}


def prf(gold: DataFrame, pred: DataFrame, by: Sequence[str], term: Sequence[str], empty: float = 0.0) -> DataFrame:
    """Set comparison per ``by`` group."""
    m = match_sets(gold, pred, [*by, *term])
    n = lambda *s: F.sum(F.col("status").isin(*s).cast("long"))
    counts = m.groupBy(*by).agg(n("TP").alias("n_tp"), n("TP", "FP").alias("n_pred"), n("TP", "FN").alias("n_gold"))
    return counts.withColumns(prf_columns(F.col("n_tp"), F.col("n_pred"), F.col("n_gold"), empty))


def evaluate(
    gold: DataFrame, pred: DataFrame, methods: Sequence[str], categories: Sequence[str], by: Sequence[str] = (), empty: float = 1.0
) -> DataFrame:
    """Per (target, category, method), cells without any prediction or gold included.

    gold: target, category, term_value; pred: method, target, category, term_value.
    ``by`` names further grouping columns of both tables (e.g. an iteration of pred).
    """
    keys = ["target", "category"]
    g = gold.select(*keys, "term_value").distinct()
    p = pred.select("method", *keys, "term_value").distinct()
    n_gold = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gold"))
    hits = p.join(g.withColumn("__hit", F.lit(1)), [*keys, "term_value"], "left").groupBy("method", *keys).agg(
        F.count(F.lit(1)).alias("n_pred"), F.count("__hit").alias("n_tp")
    )
    grid = (
        g.select("target").distinct()
        .withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    )
    out = grid.join(n_gold, keys, "left").join(hits, ["method", *keys], "left").fillna(0)
    return out.withColumns(prf_columns(F.col("n_tp"), F.col("n_pred"), F.col("n_gold"), empty))


def units(value: Column) -> Column:
    """A value of four decimals as a whole number of 1e-4, so that sums do not depend on their order."""
    return F.round(value * UNIT).cast("long")


def mean_of_units(total: Column, n: Column) -> Column:
    """total / n rounded half up to a whole unit, as a value."""
    return F.floor((2 * total + n) / (2 * n)) / UNIT


def evaluation_summary(per: DataFrame, by: Sequence[str] = ("method", "category")) -> DataFrame:
    """Mean scores of four decimals, exact before they are rounded once."""
    n = F.count(F.lit(1))
    return per.groupBy(*by).agg(
        *[mean_of_units(F.sum(units(F.col(c))), n).alias(c) for c in ("precision", "recall", "f1", "jaccard")], n.alias("n_targets")
    )


def _means_joined(rows: DataFrame, sizes: DataFrame, value: str, by: list[str], n: int, seed: int) -> DataFrame:
    slots = rows.select(*by, F.col("__k").alias("__slot")).join(sizes, by)
    draws = with_iterations(slots, n).withColumn(
        "__k", draw_int(F.col("__n"), F.lit(seed), *[F.col(c) for c in by], F.col("iteration"), F.col("__slot")) + 1
    )
    # From the left, as the draws are many times what Spark takes them for.
    return draws.join(rows, [*by, "__k"], "left").groupBy(*by, "iteration").agg(F.avg(value).alias("m"))


def _means_held(rows: DataFrame, value: str, by: list[str], n: int, seed: int) -> DataFrame:
    """(by, iteration, m): rows of a group in the order of their number, met by the draws of some iterations."""
    order = F.array_sort(F.collect_list(F.struct("__k", F.col(value).cast("double").alias("x"))))
    packs = rows.dropna(subset=by).groupBy(*by).agg(F.transform(order, lambda r: F.coalesce(r["x"], F.lit(float("nan")))).alias("__x"))
    packs = packs.withColumn("__head", F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    packs = packs.withColumn("__low", F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(HELD_ITERATIONS)))).repartition(200)

    def means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                keys, (x, head, low) = row[: len(by)], row[len(by):]
                slots, x = [str(k).encode() for k in range(1, len(x) + 1)], np.asarray(x)
                for at in range(low, min(low + HELD_ITERATIONS, n + 1)):
                    start = f"{head}|{at}|".encode()
                    digests = np.frombuffer(b"".join([hashlib.md5(start + k).digest() for k in slots]), ">u8")[::2]
                    drawn = x[((digests >> np.uint64(12)) % np.uint64(len(x))).astype("i8")]
                    drawn = drawn[~np.isnan(drawn)]
                    out.append((*keys, at, drawn.mean() if len(drawn) else None))
            yield pd.DataFrame(out, columns=[*by, "iteration", "m"])

    types = StructType([*[packs.schema[c] for c in by], StructField("iteration", IntegerType()), StructField("m", DoubleType())])
    return packs.mapInPandas(means, types)


def bootstrap_ci(
    df: DataFrame, value: str, by: Sequence[str], row_id: str, n: int = 1000, ci: float = 0.95, seed: int = 42,
    held: int = HELD_VALUES,
) -> DataFrame:
    """Mean and percentile interval of ``n`` resamples with replacement, per group.

    Groups of up to ``held`` rows are sent whole to tasks of a few iterations each,
    which look the draws up; where a group is larger, draws and rows are joined.
    """
    by = list(by)
    hashed = df.select(*by, row_id, value).withColumn("__h", F.concat(draw_hash(F.col(row_id)), F.col(row_id).cast("string")))
    rows = ordered_scan(hashed, by, hash_bucket("__h"), ["__h"], __k=row_number()).select(*by, "__k", value)
    rows = materialise(rows, "numbered")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    largest = sizes.agg(F.max("__n")).first()[0]
    means = _means_held(rows, value, by, n, seed) if (largest or 0) <= held else _means_joined(rows, sizes, value, by, n, seed)
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    q = F.percentile("m", F.array(F.lit(lo), F.lit(hi)))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), q.alias("q")).select(
        *by, F.round("mean", 4).alias("mean"), F.round(F.col("q")[0], 4).alias("ci_lower"), F.round(F.col("q")[1], 4).alias("ci_upper")
    )


def term_codes(*tables: DataFrame) -> DataFrame:
    """(category, term_value, code) of all terms, numbered and written."""
    return coded(union_all([t.select("category", "term_value") for t in tables]).filter("term_value is not null"), ["category", "term_value"], "__code")


def term_sets(rows: DataFrame, key: str, codes: DataFrame, name: str) -> DataFrame:
    """(key, category, <name>_n, <name>_terms): size and term numbers of every set of distinct rows."""
    return rows.join(codes, ["category", "term_value"], "left").groupBy(key, "category").agg(
        F.count(F.lit(1)).alias(f"{name}_n"), F.collect_list(F.col("__code").cast("int")).alias(f"{name}_terms")
    )


def random_control(
    gold: DataFrame, ann: DataFrame, categories: Sequence[str], n: int = 100, seed: int = 42, digits: tuple[int, int] = (4, 4)
) -> DataFrame:
    """Mean and spread of the Jaccard with ``n`` random sources per (target, category).

    gold: target, category, term_value; ann: source, category, term_value.
    """
    gold = materialise(gold.select("target", "category", "term_value").distinct(), "gold")
    ann = materialise(ann.select("source", "category", "term_value").distinct(), "annotations")
    sources = ann.select("source").distinct().withColumn("__h", F.concat(draw_hash(F.col("source")), F.col("source").cast("string")))
    numbered = ordered_scan(sources, [], hash_bucket("__h"), ["__h"], __k=row_number()).select("source", "__k")
    size = ann.select("source").distinct().agg(F.count(F.lit(1)).alias("__n"))
    codes = term_codes(ann, gold)
    offered = materialise(term_sets(ann, "source", codes, "p").join(numbered, "source").drop("source"), "offered")
    wanted = term_sets(gold, "target", codes, "g")
    cells = gold.select("target").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in categories])))
    cells = spread(materialise(attach(cells, size), "cells"))
    # Left joins: the draws are many times what Spark takes them for, and only the right side can be broadcast.
    draws = (
        with_iterations(cells, n)
        .withColumn("__k", draw_int(F.col("__n"), F.lit(seed), F.col("target"), F.col("category"), F.col("iteration")) + 1)
        .join(offered, ["__k", "category"], "left").join(wanted, ["target", "category"], "left")
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    none = F.array().cast("array<int>")
    shared = F.size(F.array_intersect(F.coalesce("p_terms", none), F.coalesce("g_terms", none))).cast("long")
    j = prf_columns(shared, count("p_n"), count("g_n"), 1.0)["jaccard"]
    return draws.withColumn("j", j).groupBy("target", "category").agg(
        F.round(F.avg("j"), digits[0]).alias("jaccard"), F.round(F.stddev_pop("j"), digits[1]).alias("jaccard_std")
    )


def term_masks(rows: DataFrame, key: str, codes: DataFrame, words: int, name: str) -> DataFrame:
    """(key, name): the terms of every key as bits, ``words`` longs."""
    def word(w: Column) -> Column:
        bits = F.filter("__codes", lambda c: F.floor(c / 64) == w)
        set_bit = lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (c % 64).cast("int")))
        return F.aggregate(bits, F.lit(0).cast("long"), set_bit)

    sets = rows.join(codes, ["category", "__term"]).groupBy(key).agg(F.collect_list("__code").alias("__codes"))
    return sets.select(key, F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word).alias(name))


def bits_within(mask: Column, within: Column) -> Column:
    """Number of bits that two masks share."""
    both = F.zip_with(mask, within, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda acc, x: acc + x).cast("long")


class F1Sums:
    """Summed F1 (whole units of 1e-4) per category when every target gets its sources' annotations.

    The sum runs over all gold targets; empty cells on both sides count as 1.
    Terms are numbered, so that a source or target is a mask of bits and a pair
    meets two masks; the terms of the pairs are never written out.
    """

    def __init__(self, pairs: DataFrame, ann: DataFrame, gold: DataFrame, categories: Sequence[str]):
        # A null term counts as a term and equals none.
        named = lambda df, key, side: df.select(
            key, "category", F.when(F.col("term_value").isNull(), F.lit(side)).otherwise(F.concat(F.lit("="), "term_value")).alias("__term")
        ).distinct()
        ann = materialise(named(ann, "source", "p"), "annotations")
        gold = materialise(named(gold, "target", "g"), "gold")
        codes = coded(union_all([t.select("category", "__term") for t in (ann, gold)]), ["category", "__term"], "__code")
        self.words = codes.count() // 64 + 1
        self.offered = materialise(term_masks(ann, "source", codes, self.words, "__p"), "offered")
        masks = term_masks(gold, "target", codes, self.words, "__g")
        # Targets whose gold has no named category are targets too.
        self.wanted = materialise(gold.select("target").distinct().join(masks, "target", "left"), "wanted")
        self.categories = list(categories)
        # A shuffle keeps the targets of the pairs, and how often each occurs.
        paired = materialise(pairs.groupBy("target").agg(F.count(F.lit(1)).alias("__times")), "paired")
        self.paired, self.repeated = paired.select("target"), not paired.filter("__times > 1").isEmpty()
        rows = term_masks(codes.select("category", "__term"), "category", codes, self.words, "mask").collect()
        held = {r.category: r.mask for r in rows}
        self.within = [F.array(*[F.lit(x).cast("long") for x in held.get(c, [0] * self.words)]) for c in self.categories]
        self.none = F.array_repeat(F.lit(0).cast("long"), self.words)

    def __call__(self, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """(by, category, n_targets, total)."""
        by = list(by)
        # Left joins first: pairs may be many times what Spark takes them for, and only the right side can be broadcast.
        rows = pairs.select(*by, "source", "target").join(self.offered, "source", "left")
        rows = rows.join(self.wanted.withColumn("__in", F.lit(True)), "target", "left").filter("__in")
        p, g = F.coalesce("__p", self.none), F.coalesce("__g", self.none)
        rows = rows.select(*by, "target", p.alias("__p"), g.alias("__g"))
        if self.repeated:
            joined = [F.bit_or(F.get("__p", F.lit(w))) for w in range(self.words)]
            rows = rows.groupBy(*by, "target").agg(F.array(*joined).alias("__p"), F.first("__g").alias("__g"))
        both = F.zip_with("__p", "__g", lambda x, y: x.bitwiseAND(y))
        f1 = lambda tp, n_pred, n_gold: units(prf_columns(tp, n_pred, n_gold, 1.0)["f1"])
        # Counts are columns of their own, so that no expression is repeated.
        counts = rows.select(*by, *[
            c.alias(f"__{name}{i}") for i, w in enumerate(self.within)
            for name, c in (("t", bits_within(both, w)), ("n", bits_within(F.col("__p"), w)), ("m", bits_within(F.col("__g"), w)))
        ])
        scored = [F.sum(f1(*[F.col(f"__{x}{i}") for x in "tnm"])).alias(f"__s{i}") for i in range(len(self.within))]
        sums = counts.groupBy(*by).agg(*scored)
        if not by:
            sums = sums.fillna(0)
        # Targets without any pair: both sides empty or nothing found.
        away = self.wanted.join(self.paired, "target", "left_anti")
        alone = away.agg(*[
            F.coalesce(F.sum(F.when(bits_within(F.coalesce("__g", self.none), w) == 0, UNIT).otherwise(0)), F.lit(0)).cast("long").alias(f"__e{i}")
            for i, w in enumerate(self.within)
        ])
        n_targets = self.wanted.agg(F.count(F.lit(1)).alias("n_targets"))
        full = attach(attach(sums, alone), n_targets)
        cells = F.array(*[
            F.struct(F.lit(c).alias("category"), (F.col(f"__s{i}") + F.col(f"__e{i}")).alias("total")) for i, c in enumerate(self.categories)
        ])
        return full.select(*by, "n_targets", F.explode(cells).alias("__x")).select(*by, "__x.category", "n_targets", "__x.total")


def permutation_f1(pairs: DataFrame, ann: DataFrame, gold: DataFrame, categories: Sequence[str], n: int = 1000, seed: int = 42, plus_one: bool = False) -> DataFrame:
    """Observed mean F1 per category against targets shuffled over the pairs."""
    pairs = materialise(pairs.select("source", "target"), "pairs")
    sums = F1Sums(pairs, ann, gold, categories)
    observed = sums(pairs).select("category", F.col("total").alias("observed"))
    shuffled = permute(pairs, "source", "target", n, seed)
    null = sums(shuffled, ["iteration"]).join(observed, "category")
    add, count, targets = 1 if plus_one else 0, F.count(F.lit(1)), F.first("n_targets")
    return null.groupBy("category").agg(
        mean_of_units(F.first("observed"), targets).alias("observed_f1"),
        mean_of_units(F.sum("total"), targets * count).alias("null_mean"),
        F.round(F.stddev_pop("total") / targets / UNIT, 4).alias("null_std"),
        F.round((F.sum((F.col("total") >= F.col("observed")).cast("long")) + add) / (count + add), 4).alias("p_value"),
    )


def evaluate_by(per: DataFrame, tiers: DataFrame, tier: str) -> DataFrame:
    """Evaluation rows within each tier of their target."""
    return evaluation_summary(per.join(tiers.select("target", tier).distinct(), "target"), ["method", tier, "category"])


def calibration(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision per (method, confidence): share of predicted rows found in gold."""
    g = gold.select("target", "category", "term_value").distinct().withColumn("__hit", F.lit(1))
    return pred.join(g, ["target", "category", "term_value"], "left").groupBy("method", "transfer_confidence").agg(
        F.count(F.lit(1)).alias("n_preds"), F.count("__hit").alias("n_tp"),
        F.round(F.count("__hit") / F.count(F.lit(1)), 4).alias("precision"),
    )


def blind_violations(pairs: DataFrame, held_out: DataFrame, target_columns: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """What a predictor must not see: held-out pairs, or non-structural target categories."""
    leaked = pairs.join(held_out.select("source", "target"), ["source", "target"], "left_semi").select(
        F.lit("held_out_pair").alias("kind"), F.concat_ws("|", "source", "target").alias("value")
    )
    extra = target_columns.filter(~F.col("annotation_category").isin(list(allowed))).select(
        F.lit("target_category").alias("kind"), F.col("annotation_category").alias("value")
    ).distinct()
    return leaked.unionByName(extra)
