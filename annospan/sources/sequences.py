"""FASTA and cluster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.functions.cells import extract_accession
from annospan.operators.ordered import ordered_scan, row_number, running_sum
from annospan.sources.tables import POSITION, position_bucket, read_lines, with_position

# Marks of a species in a header, by priority.
SPECIES_MARKS = [
    ("_HUMAN", "human"),
    ("_MOUSE", "mouse"),
    ("OS=Homo sapiens", "human"),
    ("OS=Mus musculus", "mouse"),
    ("OX=9606", "human"),
    ("OX=10090", "mouse"),
]


def species_of(header: Column) -> Column:
    """Species from an explicit tag, else from the marks of a header; null if unknown."""
    tag = F.nullif(F.lower(F.regexp_extract(header, r"species=(\w+)", 1)), F.lit(""))
    found = F.lit(None).cast("string")
    for mark, species in reversed(SPECIES_MARKS):
        found = F.when(header.contains(mark), species).otherwise(found)
    return F.coalesce(tag, found)


def parse_fasta(records: DataFrame, record: str = "record") -> DataFrame:
    """(accession, entry, species, header, sequence) from ``header newline sequence`` texts."""
    text = F.regexp_replace(F.col(record), "^>", "")
    header = F.trim(F.substring_index(text, "\n", 1))
    sequence = F.regexp_replace(F.regexp_extract(text, r"(?s)\n(.*)$", 1), r"[^A-Za-z*\-]", "")
    word = F.split(header, r"\s+")[0]
    return records.withColumns({
        "accession": extract_accession(header),
        "entry": F.coalesce(F.get(F.split(word, r"\|"), F.lit(2)), F.lit("")),
        "species": species_of(header), "header": header, "sequence": sequence,
    }).drop(record).filter("header <> ''")


def read_fasta(spark: SparkSession, path: str, proteins: DataFrame | None = None) -> DataFrame:
    """FASTA scan; species unknown from the header come from the protein table."""
    raw = with_position(spark.read.option("lineSep", "\n>").text(path)).withColumnRenamed("value", "record")
    parsed = parse_fasta(raw)
    if proteins is None:
        return parsed
    return fill_species(parsed, proteins)


def fill_species(parsed: DataFrame, proteins: DataFrame) -> DataFrame:
    known = proteins.groupBy("accession").agg(F.min("species").alias("__s"))
    return parsed.join(known, "accession", "left").withColumn("species", F.coalesce("species", "__s")).drop("__s")


def fasta_text(df: DataFrame) -> DataFrame:
    """Records with ``species= gene= group=`` added to their headers."""
    tags = F.concat_ws(" ", *[
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.col(c)))
        for c, k in (("species", "species"), ("gene_symbol", "gene"), ("protein_group", "group"))
    ])
    body = F.rtrim(F.regexp_replace("sequence", "(.{60})", "$1\n"), F.lit("\n"))
    return df.select(F.concat(F.lit(">"), F.concat_ws(" ", "header", tags), F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str) -> None:
    fasta_text(df).write.mode("overwrite").text(path)


def number_clusters(lines: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Members of ``Cluster#`` blocks from ordered lines (value): cluster id and representative.

    The block number is a running count of block starts over the file order; a
    cluster of any size spreads over the splits it was read from.
    """
    start = F.col("value").startswith("Cluster#")
    scanned = ordered_scan(lines, [], bucket, order, cluster_id=running_sum(start.cast("long")))
    heads = scanned.filter(F.col("value").startswith(">"))
    members = heads.withColumns({"accession": extract_accession(F.col("value")), "species": species_of(F.col("value"))})
    reps = members.groupBy("cluster_id").agg(F.min_by("accession", F.struct(*order)).alias("representative"))
    return members.join(reps, "cluster_id").select("accession", "species", "representative", "cluster_id", *order)


def rank_clusters(lines: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Members of ``representative member`` lines; the cluster id is the rank of first appearance."""
    words = F.split(F.trim("value"), r"\t|\s+")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#") & (F.size(words) >= 2)).select(
        words[0].alias("rep_raw"), extract_accession(words[0]).alias("representative"), extract_accession(words[1]).alias("accession"), *order
    ).filter(~F.lower("rep_raw").isin("representative", "cluster", "rep"))
    firsts = rows.groupBy("representative").agg(F.min(F.struct(*order)).alias("f")).select("representative", "f.*")
    ranked = ordered_scan(firsts, [], bucket, order, cluster_id=row_number()).select("representative", "cluster_id")
    return rows.drop("rep_raw").join(ranked, "representative").select("accession", "representative", "cluster_id", *order)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster file in either format; block files are recognised by their first line."""
    lines = read_lines(spark, path)
    head = spark.read.text(path).filter("trim(value) <> ''").head()
    blocks = head is not None and (head["value"].startswith("Cluster#") or head["value"].startswith(">"))
    parse = number_clusters if blocks else rank_clusters
    return parse(lines, POSITION, position_bucket())
