"""Small building blocks shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as scalar subqueries (no join)."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def product(left: DataFrame, right: DataFrame, parts: int = 16) -> DataFrame:
    """Every left row with every right row, for grids that are the result itself.

    Both sides must be aggregates. The right side is spread over ``parts``
    and met by an equi join, so neither side has to fit into one task.
    """
    spread = right.withColumn("__part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)).cast("int"))
    copies = left.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return copies.join(spread, "__part").drop("__part")
