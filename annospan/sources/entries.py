"""Domain-entry JSON: locations, member databases and structural hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.cells import norm_space
from annospan.functions.spans import ranges_text, slice_sequence

ENTRY_SCHEMA = (
    "metadata struct<accession:string,name:string,type:string,source_database:string,integrated:string,description:string,"
    "go_terms:array<struct<identifier:string,category:struct<code:string,name:string>>>,"
    "member_databases:map<string,map<string,string>>>,"
    "proteins array<struct<accession:string,"
    "entry_protein_locations:array<struct<fragments:array<struct<start:int,end:int>>>>>>"
)
# Codes of the three GO aspects.
ASPECT_CODES = {
    "go_terms_mf": ["F", "MOLECULAR_FUNCTION", "MF"],
    "go_terms_bp": ["P", "BIOLOGICAL_PROCESS", "BP"],
    "go_terms_cc": ["C", "CELLULAR_COMPONENT", "CC"],
}
CATH_SOURCES = ["cathgene3d", "cath-gene3d"]


def parse_entries(df: DataFrame, json: str = "entry") -> DataFrame:
    return df.withColumn("e", F.from_json(json, ENTRY_SCHEMA)).drop(json)


def _locations(accession: str) -> Column:
    mine = F.filter("e.proteins", lambda p: F.upper(p["accession"]) == F.upper(accession))
    return F.get(mine, F.lit(0))["entry_protein_locations"]


def entries_to_domains(df: DataFrame, accession: str = "accession", sequence: str | None = None) -> DataFrame:
    """One row per location of a domain entry on the protein of the row."""
    m = "e.metadata"
    # The test is part of the explode: a filter on the entry would move below its parser and parse it once more.
    is_domain = F.lower(F.trim(F.col(f"{m}.type"))) == "domain"
    rows = df.select(
        accession, *([sequence] if sequence else []), "e", F.posexplode(F.when(is_domain, _locations(accession))).alias("li", "loc")
    )
    valid = F.filter("loc.fragments", lambda g: g["start"] <= g["end"])
    rows = rows.withColumn("segments", valid).filter(F.size("segments") > 0)
    go = F.filter(F.col(f"{m}.go_terms"), lambda g: g["identifier"].startswith("GO:"))
    code = lambda g: F.upper(F.coalesce(F.nullif(g["category"]["code"], F.lit("")), g["category"]["name"], F.lit("")))
    ids = lambda arr: F.coalesce(F.array_join(F.transform(arr, lambda g: g["identifier"]), ";"), F.lit(""))
    out = {
        "entry": F.col(f"{m}.accession"), "name": F.coalesce(f"{m}.name", F.lit("")),
        "source_database": F.trim(F.coalesce(f"{m}.source_database", F.lit(""))),
        "integrated": F.coalesce(f"{m}.integrated", F.lit("")),
        "description": norm_space(F.coalesce(f"{m}.description", F.lit(""))),
        "occurrence_index": F.col("li") + 1, "n_fragments": F.size("segments"),
        "start": F.array_min(F.transform("segments", lambda g: g["start"])),
        "end": F.array_max(F.transform("segments", lambda g: g["end"])),
        "ranges": ranges_text(F.col("segments")), "go_terms": ids(go),
    }
    for name, codes in ASPECT_CODES.items():
        out[name] = ids(F.filter(go, lambda g: code(g).isin(codes)))
    if sequence:
        parts = F.transform("segments", lambda g: slice_sequence(F.col(sequence), g["start"], g["end"]))
        out["sequences"] = F.array_join(F.filter(parts, lambda s: s != ""), ";")
    return rows.withColumns(out).drop("e", "li", "loc", *([sequence] if sequence else []))


def entry_members(df: DataFrame) -> DataFrame:
    """(entry, name, member_db, member_accession, member_name) of integrated entries."""
    m = "e.metadata"
    # The test is part of the explode, see entries_to_domains.
    own = F.lower(F.trim(F.col(f"{m}.source_database"))) == "interpro"
    dbs = df.select(F.col("e.metadata"), F.explode(F.when(own, F.col(f"{m}.member_databases"))).alias("member_db", "accs"))
    dbs = dbs.select(F.col("metadata.accession").alias("entry"), F.col("metadata.name").alias("name"), "member_db", "accs")
    return dbs.select("entry", "name", "member_db", F.explode("accs").alias("member_accession", "member_name"))


def cath_levels(code: Column) -> dict[str, Column]:
    parts = F.split(code, r"\.")
    full = F.size(parts) >= 4
    level = lambda i: F.when(full, F.get(parts, F.lit(i))).otherwise("")
    return {"cath_class": level(0), "cath_arch": level(1), "cath_topology": level(2)}


def entries_to_structures(df: DataFrame, accession: str = "accession") -> DataFrame:
    """One row per structural entry with all its fragments and the levels of its code."""
    acc = F.col("e.metadata.accession")
    source = F.lower(F.trim(F.coalesce("e.metadata.source_database", F.lit(""))))
    rows = df.filter(source.isin(CATH_SOURCES) | acc.startswith("G3DSA:"))
    frags = F.flatten(F.transform(_locations(accession), lambda x: x["fragments"]))
    code = F.when(acc.contains(":"), F.regexp_extract(acc, r"^[^:]*:(.*)$", 1)).otherwise(acc)
    return rows.select(
        accession, acc.alias("struct_id"), code.alias("cath_superfamily"),
        *[c.alias(n) for n, c in cath_levels(code).items()],
        F.coalesce(frags, F.array()).alias("segments"),
    ).withColumn("ranges", ranges_text(F.col("segments"))).withColumn("n_fragments", F.size("segments"))


def merge_entry_sources(first: DataFrame, second: DataFrame, position: str = "position") -> DataFrame:
    """Union of two entry sources; equal (accession, first fragment) keeps the first source."""
    both = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1)))
    frag = F.get(F.get(F.get("e.proteins", F.lit(0))["entry_protein_locations"], F.lit(0))["fragments"], F.lit(0))
    keyed = both.withColumns({"__a": F.coalesce("e.metadata.accession", F.lit("")), "__f": frag["start"], "__t": frag["end"]})
    own = [c for c in first.columns if c not in ("e", position)]
    best = F.min_by(F.struct(position, "e", "__s"), F.struct("__s", position)).alias("r")
    return keyed.groupBy(*own, "__a", "__f", "__t").agg(best).select(*own, f"r.{position}", "r.e", F.col("r.__s").alias("source_rank"))
