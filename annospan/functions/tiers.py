"""Tiers and text bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence_tier(same_cluster: Column, same_symbol: Column, same_group: Column, similarity: Column) -> Column:
    return (
        F.when(same_cluster & (same_symbol | same_group), "high_confidence")
        .when(same_cluster | same_symbol, "probable")
        .when(same_group & (similarity >= 0.7), "possible")
        .otherwise("low_confidence")
    )


def difficulty_tier(similarity: Column, exact: Column | None = None) -> Column:
    easy = similarity >= 0.999
    if exact is not None:
        easy = easy | F.coalesce(exact, F.lit(False))
    return F.when(easy, "easy").when(similarity >= 0.7, "medium").otherwise("hard")


def ari_band(ari: Column) -> Column:
    return (
        F.when(ari >= 0.8, "near-perfect agreement")
        .when(ari >= 0.6, "strong agreement")
        .when(ari >= 0.4, "moderate agreement")
        .when(ari >= 0.2, "weak agreement")
        .when(ari >= 0.0, "near-random agreement")
        .otherwise("worse than random (possible systematic disagreement)")
    )
