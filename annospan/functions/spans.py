"""Interval arithmetic on 1-based inclusive coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:int,end:int>>"


def overlap_len(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))


def interval_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s2 - e1, s1 - e2, F.lit(0))


def segments_distance(segments: Column, start: Column, end: Column) -> Column:
    return F.array_min(F.transform(segments, lambda g: interval_distance(g["start"], g["end"], start, end)))


def parse_ranges(c: Column) -> Column:
    """``a..b;c-d`` -> array of segments; malformed or reversed parts are dropped."""
    pattern = r"^\s*(\d+)\s*(?:\.\.|-)\s*(\d+)\s*$"
    parts = F.split(F.coalesce(c, F.lit("")), ";")
    segs = F.transform(
        F.filter(parts, lambda p: p.rlike(pattern)),
        lambda p: F.struct(
            F.regexp_extract(p, pattern, 1).cast("int").alias("start"),
            F.regexp_extract(p, pattern, 2).cast("int").alias("end"),
        ),
    )
    return F.filter(segs, lambda g: g["start"] <= g["end"])


def ranges_text(segments: Column) -> Column:
    return F.array_join(
        F.transform(segments, lambda g: F.concat_ws("..", g["start"].cast("string"), g["end"].cast("string"))), ";"
    )


def relative(pos: Column, length: Column) -> Column:
    return F.when(length > 0, F.bround(pos / length, 4))


def positional_category(
    start: Column, end: Column, length: Column, n_cut: float = 0.2, c_cut: float = 0.8
) -> Column:
    """Third of the sequence an interval lies in; the N-terminal test wins."""
    return (
        F.when(length.isNull() | (length <= 0), "unknown")
        .when(start / length < n_cut, "Nterminal")
        .when(end / length > c_cut, "Cterminal")
        .otherwise("Internal")
    )


def normalize_positional_category(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    middle = s.startswith("cent") | s.startswith("i") | s.isin("middle")
    return (
        F.when(middle, "Internal")
        .when(s.startswith("n"), "Nterminal")
        .when(s.startswith("c"), "Cterminal")
        .otherwise("unknown")
    )


def slice_sequence(seq: Column, start: Column, end: Column) -> Column:
    """Sub-sequence of an interval; empty when it leaves the sequence."""
    inside = (start >= 1) & (end <= F.length(seq)) & (start <= end)
    return F.when(inside, F.substring(seq, start, end - start + 1)).otherwise("")


def residue(seq: Column, pos: Column) -> Column:
    return slice_sequence(seq, pos, pos)


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def numbered_text(items: Column, render) -> Column:
    """``1) ... ; 2) ...`` from an ordered array."""
    rows = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), render(x)))
    return F.array_join(rows, " ; ")


def pretty_instances(items: Column) -> Column:
    """items: sorted array<struct<start,end,label,db,acc,pos,signatures:array>>."""
    return numbered_text(
        items,
        lambda x: F.concat(
            x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(" | "), x["label"],
            F.lit(" ["), x["db"], F.lit(":"), x["acc"], F.lit("] | pos="), x["pos"],
            F.lit(" | sigs="), F.array_join(x["signatures"], ", "),
        ),
    )


def pretty_domains(items: Column) -> Column:
    """items: array<struct<name,acc,ranges>>."""
    return numbered_text(
        items, lambda x: F.concat(x["name"], F.lit(" ("), x["acc"], F.lit(") | ranges="), x["ranges"])
    )


def pretty_signatures(items: Column) -> Column:
    """items: array<struct<db,acc,name,ranges>>; blank parts are left out."""

    def render(x):
        head = F.when(x["db"] != "", F.concat(F.upper(x["db"]), F.lit(":"), x["acc"])).otherwise(x["acc"])
        name = F.when(x["name"] != "", F.concat(F.lit(" ("), x["name"], F.lit(")"))).otherwise("")
        ranges = F.when(x["ranges"] != "", F.concat(F.lit(" | ranges="), x["ranges"])).otherwise("")
        return F.concat(head, name, ranges)

    return F.array_join(F.transform(items, render), " ; ")
