"""Mixing of sources to target weights by a low-discrepancy schedule of token blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annospan.llm.tables import unused
from annospan.operators.common import attach
from annospan.operators.ordered import ordered_scan, row_number, running_sum
from annospan.session import materialise

GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"
SHARE_BINS = 1024
SLOT_RANGE = 4096
ROWS_PER_PART = 2048


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """(source, source_size, target): the total shared out by weight.

    Sources in code point order, null last, take the weights in turn. A target
    stops at ``max_repeats`` times the source's size and the excess goes to the
    others by weight: targets are ``least(cap, weight * level)``, where the level
    comes from running sums over the sources in the order of cap by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ordered = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number"), F.lit(len(weights))) + 1)
    capped = (
        ordered.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    fill = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    leveled = capped.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(fill), zero))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), zero)),
    )
    fits = F.col("level") <= F.col("ratio") * (1 + 1e-12)
    final = leveled.withColumn("final", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct("ratio", "number"))).over(every))
    return final.select(
        "source", "number", "source_size", F.least("cap", F.col("weight") * F.col("final")).alias("target")
    )


def golden_schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, number, rank, block, pass, length): which block of which source stands in each slot.

    Slot ``t`` looks up the point ``frac(t * golden ratio)`` in the cumulative
    target shares. The slots of a source are ranked; rank ``r`` takes block
    ``r mod n_blocks`` of the source's shuffled stream, pass after pass, until
    the target is reached; the last slot is cut to it. Ranks the points do not
    reach are appended at the end, so the taken words equal the rounded target.
    """
    every = Window.orderBy("number")
    total = F.sum("target").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum("target").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    words = F.round("target").cast("long")
    plans = (
        targets.filter("source_size > 0 and target > 0")
        .withColumn("words", words)
        .filter("words > 0")
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
        .withColumn("quota", F.expr(f"words div source_size * n_blocks + ceil((words % source_size) / {block})").cast("long"))
        .withColumn("low", before / total)
        .withColumn("high", (before + F.col("target")) / total)
    )
    plans = materialise(plans, "mix-plans")
    # the slot table is a range whose length is one number of the plan
    n_slots = plans.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    point = F.col("id") * F.lit(GOLDEN)
    slots = plans.sparkSession.range(n_slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    slots = slots.withColumn("bin", F.floor(F.col("u") * SHARE_BINS).cast("int"))
    bins = plans.withColumn(
        "bin",
        F.explode(F.sequence(F.floor(F.col("low") * SHARE_BINS).cast("int"), F.floor(F.col("high") * SHARE_BINS).cast("int"))),
    ).select("bin", "low", "high", "number")
    drawn = slots.join(bins, "bin").filter("u >= low and u < high").select("slot", "number")
    ranked = ordered_scan(drawn, ["number"], F.floor(F.col("slot") / SLOT_RANGE), ["slot"], rank=row_number())
    used = ranked.join(plans.select("number", "quota"), "number").filter("rank <= quota").select("slot", "number", "rank")
    got = used.groupBy("number").agg(F.max("rank").alias("got"))
    missing = (
        plans.join(got, "number", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("got < quota")
        .select("number", F.explode(F.sequence(F.col("got") + 1, F.col("quota"))).alias("rank"))
        .select((F.lit(n_slots) + F.col("rank")).alias("slot"), "number", "rank")
    )
    placed = used.unionByName(missing).join(plans.select("number", "n_blocks", "words", "source_size"), "number")
    start = F.expr(f"pass * source_size + block * {block}")
    return (
        placed.withColumn("rank", F.col("rank") - 1)
        .withColumn("block", F.expr("rank % n_blocks"))
        .withColumn("pass", F.expr("rank div n_blocks"))
        .withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("words") - start))
        .select("slot", "number", "rank", "block", "pass", "length")
    )


def source_hash(source_col: str) -> Column:
    """Hash of a source; null is a source of its own."""
    return F.xxhash64(F.col(source_col).isNull(), F.col(source_col))


def taken_words(docs: DataFrame, weights: Sequence[float], max_repeats: int, block: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, th, sh, size, source_size, target, taken, passes) of every document, ``th`` and ``sh`` hashing its text and source; see ``mix_sources``."""
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), source_hash(source_col).alias("sh"),
        ).withColumn("h", F.xxhash64(F.col("id"), F.col("th"), F.lit(seed))),
        "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = materialise(source_targets(sizes, weights, max_repeats), "mix-targets")
    numbered = rows.join(
        targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))
    ).drop("source", "own")
    parts = attach(numbered.filter("size > 0"), rows.agg(F.greatest(F.lit(1), F.expr(f"count(1) div {ROWS_PER_PART}")).alias("parts")))
    part = F.floor((F.col("h") / F.lit(2.0**64) + F.lit(0.5)) * F.col("parts"))
    offsets = ordered_scan(
        parts, ["number"], part, ["h", "id", "th", "size"], offset=running_sum(F.col("size"), exclusive=True)
    )
    pieces = offsets.withColumn(
        "block",
        F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}"))),
    ).withColumn("start", F.greatest(F.col("offset") - F.col("block") * block, F.lit(0)))
    pieces = pieces.withColumn("end", F.least(F.col("offset") + F.col("size") - F.col("block") * block, F.lit(block)))
    draws = golden_schedule(targets, block).groupBy("number", "block").agg(F.collect_list("length").alias("lengths"))
    met = pieces.join(draws, ["number", "block"], "left")
    words = F.aggregate(
        F.coalesce("lengths", F.array().cast("array<bigint>")), F.lit(0).cast("long"),
        lambda acc, n: acc + F.greatest(F.least(n, F.col("end")) - F.col("start"), F.lit(0)),
    )
    first = F.expr(f"block = offset div {block}")
    copies = F.when(first, F.size(F.filter(F.coalesce("lengths", F.array().cast("array<bigint>")), lambda n: n > F.col("start"))))
    taken = met.groupBy("number", "offset", "id", "th", "sh", "size", "source_size", "target").agg(
        F.sum(words).alias("taken"), F.max(copies).alias("passes")
    )
    nothing = numbered.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "passes": F.lit(0)})
    columns = ["id", "th", "sh", "size", "source_size", "target", "taken", "passes"]
    return taken.select(*columns).unionByName(nothing.select(*columns))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    block: int = 128,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken, passes): how much of every document a mix takes.

    ``size`` counts words, ``target`` is the words its source should give and
    ``taken`` the words the schedule takes from the document, repeats counted.
    ``passes`` says in how many passes the document's first word is taken: the
    number of copies for a mix of whole documents.

    Each source's documents are put in the order of a hash (a repeatable shuffle)
    and laid end to end; the stream is cut into blocks of equal words that the
    schedule draws. Offsets are running sums over hash parts of a source, so a
    source with any share of the rows is spread over many tasks.

    Null or blank texts have size 0 and take nothing; null is a source of its
    own; repeated rows are separate documents; an empty table gives no rows. Other
    columns are ignored.
    """
    taken = taken_words(docs, weights, max_repeats, block, seed, id_col, text_col, source_col)
    return taken.drop("th", "sh").withColumnRenamed("id", id_col)


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    block: int = 128,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` as often as the schedule takes its first word.

    A document without words is not part of any block and stays out. Repeated
    rows (equal id, text and source) share the copies taken of them; an equal id and
    text in another source is another document. Columns of ``docs`` may have any names.
    """
    taken = taken_words(docs, weights, max_repeats, block, seed, id_col, text_col, source_col)
    th, sh, own, own_th, own_sh, copies, n, copy = (
        unused(docs, c) for c in ("mix_text", "mix_source", "drawn_id", "drawn_text", "drawn_source", "drawn_copies", "drawn_rows", "mix_copy")
    )
    drawn = taken.groupBy(F.col("id").alias(own), F.col("th").alias(own_th), F.col("sh").alias(own_sh)).agg(
        F.sum("passes").alias(copies), F.count(F.lit(1)).alias(n)
    )
    tagged = docs.withColumns({th: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), sh: source_hash(source_col)})
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(th) == F.col(own_th)) & (F.col(sh) == F.col(own_sh))
    met = tagged.join(drawn.filter(F.col(copies) > 0), same)
    one = met.filter(F.col(n) == 1).unionByName(met.filter(F.col(n) > 1).dropDuplicates([own, th, sh]))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
