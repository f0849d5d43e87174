"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospan.operators.common import attach
from annospan.operators.ordered import ordered_scan, row_number, running_sum
from annospan.session import materialise

BUCKET_BITS = 12
SPLIT_BUCKETS = 256


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", together: float = 0.005
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): the corpus cut into ``shards`` contiguous runs of equal bytes.

    A row weighs its UTF-8 bytes plus one (null text: one). Rows stand in the
    order of their text's hash, so equal texts are neighbours; the bytes before a
    row come from totals per hash range plus a running sum inside the range, and
    the shard is where the row's middle falls among equal targets. A group of equal
    texts of at most ``together`` of a target stays whole; a larger one is cut
    like any other run of rows, its rows being ranked in hash parts, so no task
    holds a whole group. ``slot`` counts the rows of a shard from 0.

    Null ids and texts are rows like any other, repeated rows get slots of their
    own, an empty table gives no rows, and other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-sizes",
    )
    group = ["h", "crc", "size"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    placed = ordered_scan(
        groups, [], F.shiftright("h", 64 - BUCKET_BITS), group,
        bytes_before=running_sum(F.col("n") * F.col("size"), exclusive=True),
        rows_before=running_sum(F.col("n"), exclusive=True),
    )
    total = rows.agg(F.sum("size").alias("total"))
    joined = rows.join(placed, group)
    single = joined.filter("n = 1").withColumn("rank", F.lit(0).cast("long"))
    copies = joined.filter("n > 1").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPLIT_BUCKETS)))
    copies = copies.repartition(*group, "part")  # the join has dealt whole groups to tasks
    ranked = ordered_scan(copies, group, F.col("part"), ["part", "id"], rank=row_number())
    ranked = ranked.drop("part").withColumn("rank", F.col("rank") - 1)
    whole = F.col("n") * F.col("size") <= F.lit(together) * F.col("total") / F.lit(shards)
    middle = F.when(whole, F.expr("n * size div 2")).otherwise(F.col("rank") * F.col("size") + F.expr("size div 2"))
    position = F.col("bytes_before") + middle
    cut = (
        attach(single.unionByName(ranked), total)
        .withColumn("position", position)
        .select(
            "id", "size", "crc",
            F.least(F.expr(f"position * {shards} div total"), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("rank")).alias("place"),
        )
    )
    cut = materialise(cut, "shard-cuts")
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))
    return cut.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("place") - F.col("first")).alias("slot"),
    )
