"""Numbered region texts: ``1) 10-20 | len=11 | desc=... ; 2) ...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospan.functions.spans import numbered_text

# The item number, range and fields of the region format.
ITEM = r"\s*\d+\)\s*"
RANGE = r"(\d+)\s*-\s*(\d+)"
LENGTH = r"(?i)len\s*=\s*(\d+)"
FIELD = r"(?i)%s\s*=\s*([^;|]+)"
LISTED = "array<map<string,string>>"


def _field(item: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(item, FIELD % name, 1))


def parse_regions(c: Column) -> Column:
    """Array of (start, end, length, desc, seq, name); items without a range are dropped.

    A cell without numbered items is read as a JSON list of objects (single
    quotes are allowed), whose bounds may be called start, begin or from and end
    or to; objects without both are dropped.
    """
    items = F.filter(F.split(F.coalesce(c, F.lit("")), ITEM), lambda x: x.rlike(RANGE))

    def build(x):
        s = F.regexp_extract(x, RANGE, 1).cast("int")
        e = F.regexp_extract(x, RANGE, 2).cast("int")
        stated = F.regexp_extract(x, LENGTH, 1).try_cast("int")
        return F.struct(
            s.alias("start"), e.alias("end"), F.coalesce(stated, e - s + 1).alias("length"),
            _field(x, "desc").alias("desc"), _field(x, "seq").alias("seq"), _field(x, "name").alias("name"),
        )

    def from_object(o):
        given = lambda *names: F.coalesce(*[F.nullif(F.try_element_at(o, F.lit(n)), F.lit("")) for n in names], F.lit(None).cast("string"))
        s, e = given("start", "begin", "from").try_cast("int"), given("end", "to").try_cast("int")
        plain = lambda x: F.trim(F.coalesce(x, F.lit("")))
        return F.struct(
            s.alias("start"), e.alias("end"), F.coalesce(given("length").try_cast("int"), e - s + 1).alias("length"),
            plain(given("desc", "description", "name")).alias("desc"), plain(given("seq")).alias("seq"), plain(given("name")).alias("name"),
        )

    text = F.trim(F.coalesce(c, F.lit("")))
    objects = F.coalesce(F.from_json(F.when(text.startswith("["), text), LISTED, {"allowSingleQuotes": "true"}), F.array().cast(LISTED))
    listed = F.filter(F.transform(objects, from_object), lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    return F.when(F.size(items) > 0, F.transform(items, build)).otherwise(listed)


def render_regions(regions: Column) -> Column:
    def render(r):
        opt = lambda k: F.when(r[k] != "", F.concat(F.lit(f"{k}="), r[k]))
        return F.concat_ws(
            " | ", F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")),
            F.concat(F.lit("len="), r["length"].cast("string")), opt("seq"), opt("name"), F.concat(F.lit("desc="), r["desc"]),
        )

    return numbered_text(regions, render)


def filter_regions(df: DataFrame, col: str = "regions_pretty", word: str = "disordered") -> DataFrame:
    """Drop regions described by ``word``; re-render and count the rest."""
    kept = F.filter(parse_regions(F.col(col)), lambda r: ~F.lower(r["desc"]).contains(word))
    return df.withColumn("regions_filtered_pretty", render_regions(kept)).withColumn("region_remained_count", F.size(kept))
