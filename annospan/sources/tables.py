"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.functions.cells import blank_to_null, extract_ids, missing, norm_space
from annospan.operators.common import union_all as _union

FILE, BLOCK, ROW = "__file", "__block", "__row"
POSITION = [FILE, BLOCK, ROW]


def with_position(df: DataFrame) -> DataFrame:
    """Input order of a file scan: file, byte offset of the split, row inside it."""
    return df.withColumns({
        FILE: F.col("_metadata.file_path"),
        BLOCK: F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
        ROW: F.monotonically_increasing_id(),
    })


def position_bucket() -> Column:
    """Bucket that follows the input order, one per file split."""
    return F.concat_ws("|", FILE, BLOCK)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return with_position(spark.read.text(path))


def read_keys(spark: SparkSession, path: str, column: str = "gene", sep: str | None = None) -> DataFrame:
    """Distinct keys in order of first appearance; comment lines start with ``#``. No key at all is an error."""
    if sep:
        table = spark.read.option("header", True).option("sep", sep).option("comment", "#").csv(path)
        name = next((c for c in table.columns if c.strip().lower() == column.lower()), None)
        if name is None:
            raise ValueError(f"no column {column} in {path}")
        lines = with_position(table).select(F.trim(F.col(name)).alias(column), *POSITION)
    else:
        lines = read_lines(spark, path).select(F.trim("value").alias(column), *POSITION)
    return require_rows(distinct_keys(lines, column, POSITION), f"the key list {path}")


def distinct_keys(lines: DataFrame, column: str, position: Sequence[str]) -> DataFrame:
    kept = lines.filter(~missing(column) & ~F.col(column).startswith("#"))
    return kept.groupBy(column).agg(F.min(F.struct(*position)).alias("first_position"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def read_table(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """Delimited text as strings: cells trimmed, blanks and ``nan`` become null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", "").csv(path)
    return raw.select(*[blank_to_null(c).alias(c) for c in columns])


def scan_partitions(spark: SparkSession, glob: str, columns: Sequence[str], name_regex: str, sep: str = "\t") -> DataFrame:
    """Many per-key files as one table with the key from the file name and the source file.

    A file that cannot be read fails the job: rows are never lost without a trace.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", "").option("ignoreCorruptFiles", False).csv(glob)
    )
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_extract(path, name_regex, 1).alias("gene"), path.alias("source_file"), *[blank_to_null(c).alias(c) for c in columns]
    )


def union_all(parts: Sequence[DataFrame], min_cols: Sequence[str] = ()) -> DataFrame:
    """Union by name; absent columns and the minimum columns are filled with blanks."""
    out = _union(list(parts))
    for c in min_cols:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    strings = [c for c, t in out.dtypes if t == "string"]
    return out.fillna("", strings)


def write_tsv(df: DataFrame, path: str) -> None:
    """Header TSV; array cells become ``;`` text."""
    cols = [
        (F.array_join(c, ";") if t.startswith("array<string") else F.col(c)).alias(c) for c, t in df.dtypes
    ]
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def ntriples_lines(df: DataFrame) -> DataFrame:
    """One statement per line; literals quoted and typed."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    literal = F.when(F.col("o_type") == "string", quoted).otherwise(F.concat(quoted, F.lit("^^xsd:"), F.col("o_type")))
    obj = F.when(F.col("o_type") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(literal)
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    return df.select(F.concat_ws(" ", iri("s"), iri("p"), obj, F.lit(".")).alias("value"))


def write_ntriples(df: DataFrame, path: str) -> None:
    ntriples_lines(df).write.mode("overwrite").text(path)


def batch_status(expected: DataFrame, landed: DataFrame, key: str, errors: DataFrame | None = None) -> DataFrame:
    """OK / MISSING / ERROR per expected key with the number of landed rows."""
    counts = landed.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    out = expected.select(key).distinct().join(counts, key, "left")
    if errors is not None:
        out = out.join(errors.groupBy(key).agg(F.min("note").alias("note")), key, "left")
    else:
        out = out.withColumn("note", F.lit(None).cast("string"))
    status = F.when(F.col("note").isNotNull(), "ERROR").when(F.col("n_rows").isNull(), "MISSING").otherwise("OK")
    return out.select(key, status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("note", F.lit("")).alias("note"))


def background_pairs(df: DataFrame, accession: str, cell: str, pattern: str = r"IPR\d{6}", prefix: str = "INTERPRO:") -> DataFrame:
    """(accession, domain_type_id): every identifier of a multi-valued cell, distinct."""
    ids = F.transform(extract_ids(cell, pattern), lambda t: F.concat(F.lit(prefix), t))
    return df.filter(~missing(accession)).select(accession, F.explode(ids).alias("domain_type_id")).distinct()


def identity_distances(df: DataFrame, query: str, target: str, pident: str, position: Sequence[str]) -> DataFrame:
    """(a, b, distance): ``1 - identity / 100``; the last row of a pair wins, in either direction."""
    acc = lambda c: F.when(F.col(c).contains("|"), F.split(F.col(c), r"\|")[1]).otherwise(F.split(norm_space(c), " ")[0])
    q, t = acc(query), acc(target)
    pairs = df.select(F.least(q, t).alias("a"), F.greatest(q, t).alias("b"), (1 - F.col(pident) / 100).alias("d"), *position)
    return pairs.filter("a <> b").groupBy("a", "b").agg(F.max_by("d", F.struct(*position)).alias("distance"))


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("query string, target string, pident double").option("sep", "\t").csv(path)
    return identity_distances(with_position(raw), "query", "target", "pident", POSITION)
