"""High loadings, theme flags, merged themes and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import LOADING_SCALE, exact, if_else, in_set, mean_type, percent, reaches_mean
from themeloom.operators.joins import attach


def _with_mean_test(df: DataFrame, key: str, value: str, na_rm: bool, scale: int) -> DataFrame:
    """Adds `_reached`: the value is at or above the mean of its group.

    The mean is not divided out: value * count >= sum is exact in decimals. Groups are summed before
    the shuffle and the sums go back by a broadcast, so a group with most of the rows costs nothing extra.
    """
    sums = df.groupBy(key).agg(
        F.sum(exact(df, value, scale)).alias("_sum"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_rows")
    )
    joined = attach(df, sums, [key], "left", null_safe=[key], bounded=True)
    reached = reaches_mean(exact(df, value, scale), F.col("_sum"), F.col("_n"))
    if not na_rm:
        reached = F.when(F.col("_n") == F.col("_rows"), reached)
    return joined.withColumn("_reached", reached).drop("_sum", "_n", "_rows")


def high_loading(
    df: DataFrame, key: str = "tema", value: str = "ladning", na_rm: bool = True, scale: int = LOADING_SCALE
) -> DataFrame:
    """Rows at or above the mean of their group; floats count with `scale` digits.

    With na_rm off, a group with a missing value has no mean and loses all its rows.
    """
    return _with_mean_test(df, key, value, na_rm, scale).where("_reached").drop("_reached")


def dichotomise_mean(
    df: DataFrame,
    key: str = "tema",
    value: str = "ladning",
    out: str = "flag",
    na_rm: bool = True,
    scale: int = LOADING_SCALE,
) -> DataFrame:
    """1 at or above the mean of the group, 0 below, NULL where the value is missing."""
    tested = _with_mean_test(df, key, value, na_rm, scale)
    return tested.withColumn(out, if_else(F.col("_reached"), 1, 0).cast("int")).drop("_reached")


def merge_themes(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    ids: Sequence[str] = ("id",),
    key: str = "tema",
    value: str = "ladning",
    require_all: bool = True,
    scale: int = LOADING_SCALE,
) -> DataFrame:
    """Replace each listed group of themes by its mean per id; other themes pass through unshuffled.

    With require_all, a missing member makes the mean NULL.
    """
    members = {m: name for name, group in groups.items() for m in group}
    size = {name: len(group) for name, group in groups.items()}
    merged = F.coalesce(*[F.when(F.col(key) == m, F.lit(name)) for m, name in members.items()])
    n = F.coalesce(*[F.when(F.col(key) == name, F.lit(k)) for name, k in size.items()])
    wide_fixed = mean_type(df, value, scale)
    rest = df.where(~in_set(key, list(members))).select(*ids, key, F.col(value).cast(wide_fixed).alias(value))
    sums = (
        df.where(in_set(key, list(members)))
        .withColumn(key, merged)
        .groupBy(*ids, key)
        .agg(F.sum(exact(df, value, scale)).alias("_sum"), F.count(value).alias("_n"))
    )
    divisor = n if require_all else F.col("_n")
    mean = F.when(F.col("_n") == n, F.col("_sum") / divisor) if require_all else F.col("_sum") / divisor
    return rest.unionByName(sums.select(*ids, key, mean.cast(wide_fixed).alias(value)))


def merge_columns(df: DataFrame, groups: Mapping[str, Sequence[str]], scale: int = LOADING_SCALE) -> DataFrame:
    """The same on a wide table, as a projection: each listed group of columns becomes its mean."""
    members = [m for group in groups.values() for m in group]
    means = [
        (sum((exact(df, m, scale) for m in group[1:]), exact(df, group[0], scale)) / len(group))
        .cast(mean_type(df, group[0], scale))
        .alias(name)
        for name, group in groups.items()
    ]
    return df.select(*[c for c in df.columns if c not in members], *means)


def group_mean(df: DataFrame, by: Sequence[str], value: str, out: str = "gjennomsnitt") -> DataFrame:
    """Mean per group from an exact decimal sum, rounded to six digits."""
    mean = F.sum(exact(df, value)).cast("double") / F.count(value)
    return df.groupBy(*by).agg(F.round(mean, 6).alias(out))


def share_of(df: DataFrame, predicate: Column, out: str = "prosent") -> DataFrame:
    """One row: percent of the rows for which the predicate holds."""
    hits = F.sum(F.when(predicate, 1).otherwise(0)).cast("long")
    return df.agg(hits.alias("treff"), F.count(F.lit(1)).alias("alle")).withColumn(
        out, F.round(percent("treff", "alle"), 6)
    )


def share_of_total(df: DataFrame, by: Sequence[str], drop_null: bool = False, out: str = "prosent") -> DataFrame:
    """Count per category and its percent of all counted rows."""
    counts = count_by(df.dropna(subset=list(by)) if drop_null else df, by)
    return with_total(counts, "n").withColumn(out, F.round(percent("n", "sum"), 6))


def with_total(df: DataFrame, n: str, out: str = "sum") -> DataFrame:
    """The overall total attached to each row, from one aggregated row."""
    return df.withColumn(out, df.agg(F.sum(n)).scalar())


def count_by(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def freq_table(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, missing values left out."""
    return count_by(df.where(F.col(col).isNotNull()), [col])


def min_class_size(df: DataFrame, col: str) -> DataFrame:
    return freq_table(df, col).agg(F.min("n").alias("minste"))


def one_per_firm(df: DataFrame, firm: str, order: Sequence[str]) -> DataFrame:
    """The first row of each firm in the stated order.

    min_by keeps one row per firm and task before the shuffle, so a firm with many rows is no burden.
    """
    rest = [c for c in df.columns if c != firm]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(firm).agg(first.alias("_row")).select(firm, "_row.*")
