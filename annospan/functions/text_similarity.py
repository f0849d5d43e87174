"""Gestalt string similarity: the one measure built-in functions cannot express."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def gestalt_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)])


def char_tokens(c: Column) -> Column:
    """Characters with their occurrence number, so set overlap = multiset overlap.

    Twice the overlap over the summed lengths bounds the gestalt ratio from
    above, which makes an exact prefilter.
    """
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.transform(
        chars,
        lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(chars, x).cast("int") + 1).cast("string")),
    )


def symbol_stem(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+$", "")


def scored_symbols(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``pairs`` of distinct trimmed upper-case symbols with their similarity.

    1.0 equal, 0.9 equal up to trailing digits, 0.0 with a blank one; only the
    remaining pairs are handed to the gestalt ratio.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    known = (
        F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0))
        .when((symbol_stem(x) == symbol_stem(y)) & (symbol_stem(x) != ""), F.lit(0.9))
    )
    marked = pairs.withColumn(name, known)
    rest = marked.filter(F.col(name).isNull()).withColumn(name, F.bround(gestalt_ratio(x, y), 4))
    return marked.filter(F.col(name).isNotNull()).unionByName(rest)


def symbol_similarity(a: Column, b: Column) -> Column:
    """1.0 equal, 0.9 equal up to trailing digits, else the gestalt ratio."""
    a, b = F.upper(F.trim(a)), F.upper(F.trim(b))
    stem_a, stem_b = (F.regexp_replace(x, r"\d+$", "") for x in (a, b))
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when((stem_a == stem_b) & (stem_a != ""), F.lit(0.9))
        .otherwise(F.bround(gestalt_ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), 4))
    )
