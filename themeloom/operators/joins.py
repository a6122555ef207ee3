"""Equi-joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: Sequence[str]) -> DataFrame:
    """Join on columns named alike on both sides; keys in null_safe match NULL to NULL."""
    if not null_safe:
        return left.join(right, list(on), how)
    keys = {k: f"_right_{k}" for k in on}
    right = right.withColumnsRenamed(keys)
    tests = [F.col(k).eqNullSafe(F.col(r)) if k in null_safe else F.col(k) == F.col(r) for k, r in keys.items()]
    return left.join(right, reduce(and_, tests), how).drop(*keys.values())


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    key_counts: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join that splits the keys with many left rows into chunks of about hot_rows.

    The right rows of such a key go to each of its chunks, so every left row still meets all its
    partners exactly once. `how` is left, inner, left_semi or left_anti. key_counts, if known, holds the
    keys and their `_rows` on the left. Rows are dealt to chunks in turn, equal rows too, so the left side
    should be a table or a stored stage, which comes in the same order again after a lost executor.
    """
    on = list(on)
    hot = F.broadcast(hot_keys(left, on, hot_rows, key_counts))
    chunks = F.coalesce(F.col("_chunks"), F.lit(1).cast("long"))
    spread = F.pmod(F.monotonically_increasing_id(), chunks)
    salted_left = equi_join(left, hot, on, "left", on).withColumn("_salt", spread).drop("_chunks")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    salted_right = equi_join(right, hot, on, "left", on).withColumn("_salt", copies).drop("_chunks")
    return equi_join(salted_left, salted_right, [*on, "_salt"], how, null_safe).drop("_salt")


def hot_keys(
    df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS, key_counts: DataFrame | None = None
) -> DataFrame:
    """The keys with at least hot_rows rows and the number of chunks for each.

    Keys are counted before the shuffle. A table has at most rows / hot_rows such keys, which bounds the
    size of the result.
    """
    if key_counts is None:
        key_counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    chunks = F.ceil(F.col("_rows") / hot_rows).cast("long").alias("_chunks")
    return key_counts.where(F.col("_rows") >= hot_rows).select(*on, chunks)


def attach(
    df: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: Sequence[str] = (),
    bounded: bool = False,
    key_counts: DataFrame | None = None,
) -> DataFrame:
    """Join a table of attributes.

    bounded: the caller states that the table's size does not grow with the data, as with one row for each
    theme, topic or code; it is broadcast then. All other tables take the salted shuffle join.
    """
    if bounded:
        return equi_join(df, F.broadcast(other), on, how, null_safe)
    return salted_join(df, other, on, how, null_safe, key_counts=key_counts)


def anti_join_natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left without a partner that is equal on every shared column, NULL equal to NULL."""
    shared = [c for c in left.columns if c in right.columns]
    return equi_join(left, right.select(*shared), shared, "left_anti", shared)
