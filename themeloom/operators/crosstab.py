"""Counts and shares of theme flags by any dimension.

Long tables have one row per application and theme with a 0/1 `flag`; wide tables one flag column per theme.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import any_flag, percent

NONE_LABEL = "Ingen"


def _hits(value: int):
    return F.sum(F.when(F.col("flag") == value, 1).otherwise(0)).cast("long")


def crosstab_share(df: DataFrame, dim: Sequence[str], unit: str = "mentions", id: str = "id") -> DataFrame:
    """Flags 0 and 1 per category and the percent of 1.

    unit 'mentions' counts an application once per theme, 'documents' once in all.
    """
    if unit == "documents":
        df = df.groupBy(id, *dim).agg(F.max("flag").alias("flag"))
    counts = df.groupBy(*dim).agg(_hits(0).alias("uten"), _hits(1).alias("med"))
    return counts.withColumn("prosent", F.round(percent("med", F.col("uten") + F.col("med")), 6))


def crosstab_count(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Flagged rows per combination of categories, complete cases only."""
    return df.where("flag = 1").groupBy(*dims).agg(F.count(F.lit(1)).alias("n")).dropna("any")


def any_theme_by_dim(df: DataFrame, flags: Sequence[str], dim: str) -> DataFrame:
    """Per category: applications with any flagged theme, without, and the percent with."""
    marked = df.select(dim, any_flag(flags).alias("flag"))
    return crosstab_share(marked, [dim]).dropna("any")


def outcome_by_theme(df: DataFrame, outcome: str, theme: str = "tema") -> DataFrame:
    """Counts per theme, flag and outcome; rows without the theme get one common label."""
    label = F.when(F.col("flag") == 0, NONE_LABEL).otherwise(F.col(theme))
    counts = df.groupBy(theme, "flag", outcome).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col(theme).alias("kilde"), label.alias(theme), "flag", outcome, "n")


def grant_rate(df: DataFrame, outcome: str, granted: str, by: Sequence[str] = ("tema",)) -> DataFrame:
    """Among flagged rows with a known outcome: granted, refused and the percent granted."""
    known = df.where((F.col("flag") == 1) & F.col(outcome).isNotNull())
    yes = F.sum(F.when(F.col(outcome) == granted, 1).otherwise(0)).cast("long")
    no = F.sum(F.when(F.col(outcome) != granted, 1).otherwise(0)).cast("long")
    counts = known.groupBy(*by).agg(yes.alias("innvilget"), no.alias("avslatt"))
    return counts.withColumn("prosent", F.round(percent("innvilget", F.col("innvilget") + F.col("avslatt")), 6))


def theme_share_of_outcome(df: DataFrame, outcome: str, value: str, theme: str = "tema") -> DataFrame:
    """Among rows with the given outcome: the percent that has each theme."""
    return crosstab_share(df.where(F.col(outcome) == value), [theme])


def outcome_split(df: DataFrame, outcome: str, value: str, theme: str = "tema") -> DataFrame:
    """Per theme, its part of all rows with and of all rows without a theme for one outcome."""
    counts = df.where(F.col(outcome) == value).groupBy(theme).agg(_hits(0).alias("uten"), _hits(1).alias("med"))
    totals = counts.agg(F.struct(F.sum("uten").alias("uten"), F.sum("med").alias("med"))).scalar()
    return counts.select(
        theme,
        "uten",
        "med",
        F.round(percent("med", totals.getField("med")), 6).alias("prosent_med"),
        F.round(percent("uten", totals.getField("uten")), 6).alias("prosent_uten"),
    )
