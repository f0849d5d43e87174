"""Ordered scans that do not put a whole key into one task.

A plain ``partitionBy(key)`` window sends every row of a key to one task. Here
rows are also split by a *bucket* that follows the order (a coordinate bin, the
leading digits of a hash ...). Windows run inside (key, bucket); one small row
per (key, bucket) carries the state of the earlier or later buckets. The result
is equal to the plain window for any bucket expression that never decreases
along the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column
    exclusive: bool = False


def row_number() -> Scan:
    return Scan("sum", F.lit(1).cast("long"))


def running_sum(value: Column, exclusive: bool = False) -> Scan:
    return Scan("sum", value, exclusive)


def running_max(value: Column, exclusive: bool = False) -> Scan:
    return Scan("max", value, exclusive)


def min_ahead(value: Column, exclusive: bool = False) -> Scan:
    """Minimum over this row (or the next one) and everything after it."""
    return Scan("min_ahead", value, exclusive)


def previous(value: Column) -> Scan:
    """Value of the row before; wrap nullable values in a struct."""
    return Scan("previous", value)


def following(value: Column) -> Scan:
    return Scan("following", value)


def _frame(scan: Scan):
    if scan.kind == "min_ahead":
        return (1 if scan.exclusive else 0, Window.unboundedFollowing)
    return (Window.unboundedPreceding, -1 if scan.exclusive else 0)


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column | str,
    order: Sequence[str],
    **scans: Scan,
) -> DataFrame:
    """Add one column per scan. ``order`` (ascending) must be total within ``by``.

    A bucket given by the name of a column of ``df`` stays in the result: a second scan over
    the same buckets finds the rows where they are and does not shuffle them again.
    """
    by, order = list(by), list(order)
    named = isinstance(bucket, str)
    rows, at = (df, bucket) if named else (df.withColumn(_BUCKET, bucket), _BUCKET)
    keys = [*by, at]
    inside = Window.partitionBy(*keys).orderBy(*order)

    local_cols, totals, carries = {}, [], {}
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(at)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    rank = F.struct(*order)
    for name, scan in scans.items():
        local, total, carry = f"__l_{name}", f"__t_{name}", f"__c_{name}"
        if scan.kind in ("sum", "max", "min_ahead"):
            agg = {"sum": F.sum, "max": F.max, "min_ahead": F.min}[scan.kind]
            local_cols[local] = agg(scan.value).over(inside.rowsBetween(*_frame(scan)))
            totals.append(agg(scan.value).alias(total))
            carries[carry] = agg(total).over(after if scan.kind == "min_ahead" else before)
        elif scan.kind == "previous":
            local_cols[local] = F.lag(scan.value).over(inside)
            totals.append(F.max_by(scan.value, rank).alias(total))
            carries[carry] = F.lag(total).over(across)
        else:
            local_cols[local] = F.lead(scan.value).over(inside)
            totals.append(F.min_by(scan.value, rank).alias(total))
            carries[carry] = F.lead(total).over(across)

    state = rows.groupBy(*keys).agg(*totals).withColumns(carries).select(*keys, *carries)
    joined = rows.withColumns(local_cols).join(state, keys)

    out = {}
    for name, scan in scans.items():
        local, carry = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if scan.kind == "sum":
            out[name] = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        elif scan.kind == "max":
            out[name] = F.greatest(local, carry)
        elif scan.kind == "min_ahead":
            out[name] = F.least(local, carry)
        else:
            out[name] = F.coalesce(local, carry)
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])


def draw_hash(*parts) -> Column:
    """Repeatable random order key: hex digest of the parts joined by ``|``.

    Engine independent (any SQL engine with md5 draws the same rows) and safe
    under task retries, unlike ``rand()``.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_bucket(col: Column | str, digits: int = 2) -> Column:
    return F.substring(col, 1, digits)


def draw_int(modulus: Column, *parts) -> Column:
    """Repeatable draw in ``[0, modulus)`` from 52 bits of the digest."""
    bits = F.conv(F.substring(draw_hash(*parts), 1, 13), 16, 10).cast("long")
    return F.pmod(bits, modulus.cast("long"))


def with_iterations(df: DataFrame, n: int, name: str = "iteration") -> DataFrame:
    """One copy of the table per iteration (a fixed factor, not a join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))
