"""Probability functions as Column expressions (Spark SQL has no lgamma or erf)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ln_gamma(x: Column) -> Column:
    """Log-gamma for x >= 1: Stirling series at x + 7, stepped back by a product."""
    x = x.cast("double")
    y = x + 7.0
    inv = F.lit(1.0) / y
    inv2 = inv * inv
    series = inv * (
        F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * (F.lit(1 / 1680) - inv2 / 1188.0)))
    )
    product = x
    for k in range(1, 7):
        product = product * (x + float(k))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def with_hypergeom_tail(df: DataFrame, name: str, k: Column, total: Column, good: Column, draws: Column) -> DataFrame:
    """Add P(X >= k) when ``draws`` of ``total`` items are taken and ``good`` count as hits.

    One log-gamma term gives the probability nearest to the mode; the others
    follow by their ratio. Terms fall off at least as fast as a normal tail of twice the
    variance, so the sum ends after sixteen standard deviations: a further term, below
    1e-20 of the sum, would leave the sum as it is in double precision.
    The parts are columns of their own, so that no expression is repeated.
    """
    kept = df.columns
    k_, n, g, d = (F.col(f"__{x}") for x in "kngd")
    out = df.withColumns({f"__{x}": c.cast("double") for x, c in zip("kngd", (k, total, good, draws))})
    variance = d * (g / n) * (1 - g / n) * F.greatest(n - d, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0))
    out = out.withColumns({
        "__low": F.greatest(F.lit(0.0), d + g - n), "__high": F.least(g, d),
        "__up": k_ > F.floor((d + 1) * (g + 1) / (n + 2)), "__width": F.ceil(F.sqrt(variance) * 16) + 60,
    })
    low, high, upper, first = (F.col(f"__{x}") for x in ("low", "high", "up", "first"))
    out = out.withColumn("__first", F.least(F.greatest(F.when(upper, k_).otherwise(k_ - 1), low), high))
    terms = F.array(g, n - g, n - d, d, n, first, g - first, d - first, n - g - d + first)
    out = out.withColumns({
        "__steps": F.least(F.when(upper, high - first).otherwise(first - low), F.col("__width")).cast("int"),
        "__ln": F.transform(terms, lambda x: ln_gamma(x + 1)),
    })
    ln = F.col("__ln")
    start = F.exp(ln[0] + ln[1] + ln[2] + ln[3] - ln[4] - ln[5] - ln[6] - ln[7] - ln[8])

    def grow(acc, t):
        up, down = first + t, first - t
        ratio = F.when(upper, (g - up) * (d - up) / ((up + 1) * (n - g - d + up + 1))).otherwise(
            down * (n - g - d + down) / ((g - down + 1) * (d - down + 1))
        )
        return F.struct((acc["term"] * ratio).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    added = F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("__steps"), F.lit(0))), zero, grow, lambda a: a["total"])
    out = out.withColumn("__part", F.least(start * added, F.lit(1.0)))
    part = F.col("__part")
    tail = F.when(k_ <= low, F.lit(1.0)).when(k_ > high, F.lit(0.0)).when(upper, part).otherwise(1.0 - part)
    return out.select(*[c for c in kept if c != name], tail.alias(name))


def with_fisher_greater(df: DataFrame, name: str, a: Column, b: Column, c: Column, d: Column, repeated: bool = False) -> DataFrame:
    """Add the one-sided p of the table [[a, b], [c, d]].

    ``repeated`` tests each distinct table once and joins the result: for many
    families whose counts recur. The few tables are dealt over all cores, as each is a long sum.
    """
    if not repeated:
        return with_hypergeom_tail(df, name, a, a + b + c + d, a + c, a + b)
    cells = ["__hit", "__miss", "__back_hit", "__back_miss"]
    marked = df.withColumns(dict(zip(cells, (a, b, c, d))))
    a, b, c, d = (F.col(x) for x in cells)
    tables = marked.select(*cells).distinct().repartition(df.sparkSession.sparkContext.defaultParallelism)
    tested = with_hypergeom_tail(tables, name, a, a + b + c + d, a + c, a + b)
    return marked.join(tested, cells).drop(*cells)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """``ad / bc``; infinite when only the denominator is zero."""
    num, den = a.cast("double") * d, b.cast("double") * c
    return F.when(den != 0, num / den).when(num > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


# Coefficients of a published rational approximation of erfc
# (fractional error below 1.2e-7 everywhere).
ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc(x: Column) -> Column:
    z = F.abs(x.cast("double"))
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    poly = F.lit(ERFC[-1])
    for coefficient in reversed(ERFC[:-1]):
        poly = poly * t + coefficient
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def normal_sf(z: Column) -> Column:
    return erfc(z / math.sqrt(2.0)) * 0.5
