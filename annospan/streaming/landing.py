"""Incremental landing: new files only, de-duplicated by key.

Every micro-batch writes its own folder, so the cost of a batch depends on the
batch and a retried batch replaces only itself. Readers de-duplicate over the
batches; ``compact`` folds them into one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.functions.cells import missing
from annospan.operators.summaries import dedup_richest


def unprocessed(keys: DataFrame, landed: DataFrame, key: str, content: str, force: bool = False) -> DataFrame:
    """Keys still to be processed: never landed, or landed without content."""
    wanted = keys.select(key).distinct()
    if force:
        return wanted
    done = landed.filter(~missing(content)).select(key).distinct()
    return wanted.join(done, key, "left_anti")


def land(
    spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: Sequence[str], tie: Sequence[str],
    file_format: str = "parquet",
) -> None:
    """Process every file that arrived since the last call, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        dedup_richest(batch, list(key), list(tie)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).format(file_format).load(source)
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current(spark: SparkSession, target: str, key: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The richest row per key over all landed batches."""
    return dedup_richest(spark.read.parquet(target).drop("batch"), list(key), list(tie))


def compact(spark: SparkSession, target: str, output: str, key: Sequence[str], tie: Sequence[str]) -> None:
    current(spark, target, key, tie).write.mode("overwrite").parquet(output)
