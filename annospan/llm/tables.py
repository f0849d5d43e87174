"""Reading of the corpus tables and small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.session import materialise

CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_rest(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def text_bytes(text_col: str) -> Column:
    """UTF-8 bytes of the whole text; null becomes empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def hash_share(*key: str) -> Column:
    """Repeatable number in [0, 1) for a key."""
    return F.xxhash64(*key, F.lit("sample")) / F.lit(2.0**64) + F.lit(0.5)


def bounded_sample(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, drawn by hash of ``key``: the bounded sample a model is fitted on.

    A first cut by share leaves about the bound, so the ordered limit that makes
    it exact never gathers more than that.
    """
    share = rows / max(df.count(), 1)
    drawn = df.filter(hash_share(*key) < share) if share < 1 else df
    return drawn.orderBy(hash_share(*key), *key).limit(rows)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffle files of that one job go when it ends.

    Nothing else reads them, so the disk in use is that of one step and not of all.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        return materialise(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP_CONF)
        else:
            conf.set(CLEANUP_CONF, before)
