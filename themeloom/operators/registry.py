"""Yearly company registry extracts: clean, stack, attach to applications."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import blank_to_null, first_match, years_between
from themeloom.operators.joins import HOT_ROWS, salted_join

COLUMNS = ("org_nr", "navn", "nace1_sn07", "syss", "org_form", "fylke", "kommune", "oms", "aar", "opprettet", "alder")


def lower_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.lower() for c in df.columns if c != c.lower()})


def clean_registry(df: DataFrame, year: str, sub_unit: str = "BEDR") -> DataFrame:
    """Yearly snapshot: sub-units and rows without an id go, county, founding year and age are derived."""
    return (
        lower_headers(df)
        .where(F.col("org_form") != sub_unit)
        .withColumn("org_nr", blank_to_null("org_nr"))
        .dropna(subset=["org_nr"])
        .withColumns({"aar": F.lit(year), "fylke": first_match("fkommune", "[0-9]{1,2}")})
        .withColumnRenamed("fkommune", "kommune")
        .transform(lambda d: with_age(d, "orgnrdat"))
        .select(*COLUMNS)
    )


def clean_years(raw: DataFrame, snapshot_year: str, sub_unit: str = "BEDR") -> DataFrame:
    """clean_registry for the snapshot's rows and with_age for those of earlier years, in one pass.

    The same rows as the union of both, where one table holds the years.
    """
    late = F.col("aar") == snapshot_year
    kept = (F.col("org_form") != sub_unit) & blank_to_null("org_nr").isNotNull()
    county = F.when(late, first_match("kommune", "[0-9]{1,2}")).otherwise(F.col("fylke"))
    rows = lower_headers(raw).where(F.when(late, kept).otherwise(F.col("aar") < snapshot_year))
    return with_age(rows.withColumn("fylke", county)).select(*COLUMNS)


def largest_fan_out(applications: DataFrame, registry: DataFrame, keys: Sequence[str] = ("org_nr", "aar")) -> DataFrame:
    """One row: the most registry rows and the most applications that any key has, and their largest product.

    To be looked at before a join: the product is the number of rows one key gives.
    """
    keys = list(keys)
    count = lambda df, name: df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(applications, "a").join(count(registry, "r"), keys)
    return both.agg(F.max("a").alias("soknader"), F.max("r").alias("registerrader"), F.max(F.col("a") * F.col("r")).alias("rader"))


def with_age(df: DataFrame, founded: str = "fnr_dat") -> DataFrame:
    """Founding year and age in the extract's year, for any number of years in one table."""
    df = lower_headers(df)
    return df.withColumns(
        {"opprettet": first_match(founded, "[0-9]{1,4}"), "alder": years_between("aar", founded)}
    )


def union_registry(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack extracts by column name."""
    return reduce(DataFrame.unionByName, [lower_headers(f) for f in frames])


def join_registry(
    applications: DataFrame,
    registry: DataFrame,
    keys: Sequence[str] = ("org_nr", "aar"),
    null_keys: str = "never",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join on firm and year, with the two-digit industry code.

    null_keys: 'never' leaves an application without a firm id unmatched; 'match' lets it meet every registry row
    without one of its year, which is for cleaned registries only. A firm with a
    large share of the applications is split over many tasks.
    """
    keys = list(keys)
    safe = [keys[0]] if null_keys == "match" else []
    if null_keys == "never":
        registry = registry.dropna(subset=keys)
    joined = salted_join(applications, registry, keys, "left", safe, hot_rows)
    return joined.withColumn("nace", first_match("nace1_sn07", "[0-9]{2}"))
