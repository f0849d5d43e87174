"""Roles of the driver tables and the registry of queries.

Operators take column names, so the star schema can stand in for annotated
intervals: an order is the sequence, a line is an interval, a brand its type.
Each role has a DataFrame form and the same role as a SQL common table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.session import materialise, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for CPU-heavy row expressions: few-split files are spread over the cores."""
    return spread(table(spark, sf, name))


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def occurrences(spark: SparkSession, sf: str, read=table) -> DataFrame:
    """Lines of an order as intervals on it; the brand is the type."""
    line, part = read(spark, sf, "lineitem"), table(spark, sf, "part")
    start = (F.col("l_linenumber") * 20 + F.col("l_partkey") % 20).cast("int")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("protein"), F.col("p_brand").alias("acc"), F.col("p_type").alias("label"),
        F.col("p_name").alias("pname"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"), start.alias("start"),
        (start + F.col("l_quantity") - 1).cast("int").alias("end"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.concat_ws("-", text("l_orderkey"), text("l_partkey"), text("l_suppkey"), text("l_linenumber"), text(F.col("l_quantity").cast("int"))).alias("key"),
    )


OCC = """occ AS (
  SELECT l_orderkey AS protein, p_brand AS acc, p_type AS label, p_name AS pname, l_partkey AS part,
         l_suppkey AS supp, l_linenumber AS line,
         CAST(l_linenumber * 20 + l_partkey % 20 AS INTEGER) AS start,
         CAST(l_linenumber * 20 + l_partkey % 20 + l_quantity - 1 AS INTEGER) AS "end",
         l_returnflag AS flag, l_linestatus AS status,
         l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(l_quantity AS INTEGER) AS key
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# Kind of feature a returned line plays, by supplier.
FEATURE_KINDS = ["TRANSMEM", "SIGNAL", "BINDING", "TOPO_DOM", "COMPBIAS", "ACT_SITE"]
FEATURE_NOTES = ["Cytoplasmic", "Extracellular side", "Lumenal", "helix"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines as features on the same order."""
    kinds = F.array(*[F.lit(k) for k in FEATURE_KINDS])
    notes = F.array(*[F.lit(k) for k in FEATURE_NOTES])
    return occurrences(spark, sf).filter("flag = 'R'").select(
        "protein", F.col("start").alias("fstart"), F.col("end").alias("fend"),
        F.get(kinds, (F.col("supp") % 6).cast("int")).alias("ftype"),
        F.get(notes, (F.col("part") % 4).cast("int")).alias("note"),
        F.concat(F.lit("ChEBI:CHEBI:"), text(F.col("supp") % 7)).alias("ligand"),
        F.concat(F.lit("1.10."), text(F.col("part") % 5), F.lit("."), text(F.col("supp") % 3)).alias("superfamily"),
        F.col("key").alias("fkey"),
    )


FEAT = f"""feat AS (
  SELECT protein, start AS fstart, "end" AS fend,
         {FEATURE_KINDS}[CAST(supp % 6 AS INTEGER) + 1] AS ftype,
         {FEATURE_NOTES}[CAST(part % 4 AS INTEGER) + 1] AS note,
         'ChEBI:CHEBI:' || CAST(supp % 7 AS VARCHAR) AS ligand,
         '1.10.' || CAST(part % 5 AS VARCHAR) || '.' || CAST(supp % 3 AS VARCHAR) AS superfamily, key AS fkey
  FROM occ WHERE flag = 'R')"""


def segmented(df: DataFrame) -> DataFrame:
    """Intervals of at least 31 residues that end in status F get a gap of their middle third."""
    third = F.floor((F.col("end") - F.col("start") + 1) / 3).cast("int")
    split = (F.col("status") == "F") & (F.col("end") - F.col("start") >= 30)
    seg = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return df.withColumn(
        "segments",
        F.when(split, F.array(
            seg(F.col("start"), F.col("start") + third - 1), seg(F.col("end") - third + 1, F.col("end"))
        )).otherwise(F.array(seg(F.col("start"), F.col("end")))),
    )


SEG = """seg AS (
  SELECT key, protein, start AS s1, CASE WHEN status = 'F' AND "end" - start >= 30
           THEN start + ("end" - start + 1) // 3 - 1 ELSE "end" END AS e1
  FROM occ
  UNION ALL
  SELECT key, protein, "end" - ("end" - start + 1) // 3 + 1, "end" FROM occ WHERE status = 'F' AND "end" - start >= 30)"""


def foreground(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(foreground, background) pairs of (customer, type): one market segment against all."""
    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    feature = F.concat_ws(":", "p_brand", "p_type").alias("feature")
    pairs = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("entity"), feature).distinct()
    )
    pairs = materialise(pairs, "pairs")  # both sides read them: orders and lines are joined once
    named = customer.select(F.col("c_custkey").alias("entity"), "c_mktsegment", "c_nationkey")
    return pairs.join(named.filter("c_mktsegment = 'BUILDING'"), "entity", "left_semi"), pairs


PAIRS = """bg AS (
  SELECT DISTINCT o_custkey AS entity, p_brand || ':' || p_type AS feature
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
fg AS (SELECT bg.* FROM bg JOIN customer ON c_custkey = entity WHERE c_mktsegment = 'BUILDING')"""

# One-sided Fisher tail and odds ratio as SQL macros in text form.
def sql_ln_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def sql_tail(k: str, total: str, good: str, draws: str) -> str:
    """Sum of the upper tail term by term."""
    term = f"exp({sql_ln_choose(good, 'i')} + {sql_ln_choose(f'({total} - {good})', f'({draws} - i)')} - {sql_ln_choose(total, draws)})"
    return (
        f"least(1.0, list_sum(list_transform(range(CAST({k} AS BIGINT), CAST(least({good}, {draws}) AS BIGINT) + 1), "
        f"lambda i: {term})))"
    )
