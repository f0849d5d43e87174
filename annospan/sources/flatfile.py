"""Flat-file protein records: one text per record, every section as an expression.

A record is at most a few hundred kilobytes, so all sections are read with
higher-order functions inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annospan.functions.cells import norm_space
from annospan.functions.spans import slice_sequence
from annospan.sources.tables import with_position

# Cross-reference databases, comment topics, name patterns, feature header, qualifier.
XREF_DATABASES = ["Pfam", "SMART", "PROSITE", "CATH", "Reactome", "KEGG"]
COMMENT_TOPICS = ["FUNCTION", "COFACTOR", "ACTIVITY REGULATION", "SUBUNIT", "INTERACTION", "SUBCELLULAR LOCATION"]
NAME_PATTERNS = [r"RecName:\s*Full=([^;]+);", r"SubName:\s*Full=([^;]+);", r"Full=([^;]+);"]
FEATURE_HEADER = r"^(\w+)\s+([<>]?\d+)(?:\.\.([<>]?\d+))?\s*(.*)$"
QUALIFIER = r'^/([^=]+)=(?:"([^"]*)"|(.+))$'
FEATURE_COUNTS = ["REGION", "COMPBIAS", "DOMAIN", "MOTIF"]
GO_ASPECTS = {"go_mf_ids": "F", "go_bp_ids": "P", "go_cc_ids": "C"}


def read_flatfile(spark: SparkSession, path: str) -> DataFrame:
    """(record, position): text between ``//`` lines."""
    raw = spark.read.option("lineSep", "\n//\n").text(path)
    return with_position(raw).withColumnRenamed("value", "record").filter(F.length(F.trim("record")) > 0)


def _lines(record: Column, code: str) -> Column:
    """Bodies of the lines with a two-letter code."""
    lines = F.filter(F.split(record, r"\r?\n"), lambda x: x.startswith(f"{code}   "))
    return F.transform(lines, lambda x: F.rtrim(F.substring(x, F.lit(6), F.length(x))))


def parse_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Identifier, names, gene names, sequence and length of each record."""
    rec = F.col(record)
    names = F.array_join(F.transform(_lines(rec, "DE"), lambda x: F.trim(x)), " ")
    name = F.coalesce(*[F.nullif(F.regexp_extract(names, p, 1), F.lit("")) for p in NAME_PATTERNS], F.lit(""))
    genes = F.flatten(F.transform(
        _lines(rec, "GN"),
        lambda x: F.concat(
            F.regexp_extract_all(x, F.lit(r"Name=([^;{]+)"), F.lit(1)),
            F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"Synonyms=([^;{]+)"), F.lit(1)), lambda s: F.split(s, ","))),
        ),
    ))
    genes = F.filter(F.transform(genes, lambda g: F.trim(g)), lambda g: g != "")
    tail = F.regexp_extract(rec, r"(?s)(?:^|\n)SQ [^\n]*\n(.*)$", 1)
    sequence = F.regexp_replace(F.regexp_replace(tail, r"(?s)(^|\n)//.*$", ""), "[^A-Za-z]", "")
    stated = F.regexp_extract(rec, r"(?:^|\n)SQ [^\n]*?(\d+)\s+AA;", 1).try_cast("int")
    return df.withColumns({
        "entry_id": F.regexp_extract(rec, r"(?:^|\n)ID\s+(\S+)", 1),
        "protein_name": name,
        "genes": F.array_join(genes, ";"),
        "sequence": sequence,
        "protein_length": F.when(F.length(sequence) > 0, F.length(sequence)).otherwise(F.coalesce(stated, F.lit(0))),
    })


def flat_xrefs(df: DataFrame, record: str = "record") -> DataFrame:
    """Cross-reference arrays by database; GO identifiers by aspect, sorted and distinct."""
    refs = F.transform(_lines(F.col(record), "DR"), lambda x: F.trim(x))
    out = {}
    for db in XREF_DATABASES:
        hits = F.transform(F.filter(refs, lambda x: x.startswith(f"{db};")), lambda x: F.regexp_extract(x, r";\s*([^;\s]+)", 1))
        out[f"{db.lower()}_ids"] = F.filter(hits, lambda t: t != "")
    go = F.filter(F.transform(
        F.filter(refs, lambda x: x.startswith("GO;")),
        lambda x: F.struct(
            F.trim(F.split(x, ";")[1]).alias("id"), F.trim(F.split(F.coalesce(F.get(F.split(x, ";"), F.lit(2)), F.lit("")), ":")[0]).alias("aspect"),
        ),
    ), lambda g: g["id"].startswith("GO:"))
    out["go_ids"] = F.array_sort(F.array_distinct(F.transform(go, lambda g: g["id"])))
    for name, code in GO_ASPECTS.items():
        out[name] = F.array_sort(F.array_distinct(F.transform(F.filter(go, lambda g: g["aspect"] == code), lambda g: g["id"])))
    return df.withColumns(out)


def flat_comments(df: DataFrame, record: str = "record") -> DataFrame:
    """One folded text per comment topic; the last block of a topic wins."""
    body = F.array_join(_lines(F.col(record), "CC"), "\n")
    blocks = F.transform(
        F.split(body, r"(?m)^-!-"),
        lambda b: F.struct(
            F.upper(F.trim(F.regexp_extract(b, r"^\s*([^:]+):", 1))).alias("topic"),
            norm_space(F.regexp_replace(b, r"^\s*[^:]+:\s*", "")).alias("text"),
        ),
    )
    out = {}
    for topic in COMMENT_TOPICS:
        hits = F.filter(blocks, lambda b: b["topic"] == topic)
        out["cc_" + topic.lower().replace(" ", "_")] = F.when(F.size(hits) > 0, F.element_at(hits, -1)["text"]).otherwise("")
    return df.withColumns(out)


def _rest(items: Column) -> Column:
    """All but the first element."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value made once: what a lambda names several times would be made each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feature_array(record: Column) -> Column:
    """Array of (type, start, end, note, ftid, qualifiers) in file order."""
    mark = "\u0001"
    bodies = F.transform(
        _lines(record, "FT"), lambda x: _let(F.trim(x), lambda y: F.when(y.rlike(FEATURE_HEADER), F.concat(F.lit(mark), y)).otherwise(x))
    )
    blocks = _rest(F.split(F.array_join(bodies, "\n"), mark))
    value = lambda x: norm_space(F.concat(F.regexp_extract(x, QUALIFIER, 2), F.regexp_extract(x, QUALIFIER, 3)))

    def line(x):
        """(k, v): a qualifier, or a line of the note without a key."""
        return F.when(x.rlike(QUALIFIER), F.struct(F.trim(F.regexp_extract(x, QUALIFIER, 1)).alias("k"), value(x).alias("v"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("k"), x.alias("v"))
        )

    def qualifiers(pairs):
        """Values by key, keys in order of appearance."""
        lists = lambda keys: F.map_from_arrays(keys, F.transform(
            keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
        ))
        return _let(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lists)

    def build(lines):
        head = lines[0]
        rest = F.filter(_rest(lines), lambda x: x.startswith(" " * 11))
        return _let(F.transform(rest, lambda x: _let(F.trim(x), line)), lambda told: _feature(head, told))

    def _feature(head, told):
        number = lambda g: F.regexp_extract(F.regexp_extract(head, FEATURE_HEADER, g), r"(\d+)", 1).try_cast("int")
        notes = F.transform(F.filter(told, lambda p: p["k"].isNull() | (F.lower(p["k"]) == "note")), lambda p: p["v"])
        ids = F.filter(told, lambda p: p["k"] == "FTId")
        return F.struct(
            F.upper(F.regexp_extract(head, FEATURE_HEADER, 1)).alias("type"),
            number(2).alias("start"),
            F.coalesce(number(3), number(2)).alias("end"),
            norm_space(F.concat_ws(" ", F.regexp_extract(head, FEATURE_HEADER, 4), F.array_join(notes, " "))).alias("note"),
            F.when(F.size(ids) > 0, F.element_at(ids, -1)["v"]).otherwise("").alias("ftid"),
            _let(F.filter(told, lambda p: p["k"].isNotNull()), qualifiers).alias("qualifiers"),
        )

    return F.transform(blocks, lambda block: _let(F.split(block, "\n"), build))


def flat_features(df: DataFrame, record: str = "record") -> DataFrame:
    """Feature array, the number of features and of those of the counted types.

    Numbers are taken from the header lines alone, so a reader of the numbers pays for no feature.
    """
    heads = F.filter(F.transform(_lines(F.col(record), "FT"), lambda x: F.trim(x)), lambda x: x.rlike(FEATURE_HEADER))
    out = df.withColumn("__types", F.transform(heads, lambda x: F.upper(F.regexp_extract(x, FEATURE_HEADER, 1))))
    counts = {f"{t.lower()}_count": F.size(F.filter("__types", lambda x: x == t)) for t in FEATURE_COUNTS}
    out = out.withColumns({"n_features": F.size("__types")} | counts).drop("__types")
    return out.withColumn("features", feature_array(F.col(record)))


def feature_table(df: DataFrame, key: str, types: list[str] | None = None, sequence: str | None = None) -> DataFrame:
    """One row per feature, with its sub-sequence where a sequence column is named."""
    cols = [key] + ([sequence] if sequence else [])
    rows = df.select(*cols, F.posexplode("features").alias("position", "f")).select(
        *cols, "position", F.col("f.type").alias("ftype"), F.col("f.start").alias("fstart"), F.col("f.end").alias("fend"),
        F.col("f.note").alias("note"), F.col("f.ftid").alias("ftid"), F.col("f.qualifiers").alias("qualifiers"),
    )
    if types:
        rows = rows.filter(F.col("ftype").isin(types))
    if sequence:
        sub = F.coalesce(slice_sequence(F.col(sequence), F.col("fstart"), F.col("fend")), F.lit(""))
        rows = rows.withColumn("feature_sequence", sub).drop(sequence)
    return rows
