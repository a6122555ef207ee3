"""Between long and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str, value: str) -> DataFrame:
    """One row per id and column; missing values are kept."""
    return df.unpivot(list(ids), list(cols), key, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str], value: str, check_unique: bool = True
) -> DataFrame:
    """One column per listed key value, in one shuffle on the ids.

    A second row for the same id and key stops the job, because either value would be a guess.
    """

    def cell(v: str):
        here = F.col(key) == v
        found = F.max(F.when(here, F.col(value)))
        if check_unique:
            found = F.when(
                F.count(F.when(here, 1)) > 1, F.raise_error(F.lit(f"more than one row for {key} = {v}"))
            ).otherwise(found)
        return found.alias(v)

    return df.groupBy(*ids).agg(*[cell(v) for v in values])


def vectors_to_long(
    df: DataFrame,
    ids: Sequence[str],
    vector: str,
    key: str = "tema",
    value: str = "ladning",
    topics: Sequence[str] | None = None,
) -> DataFrame:
    """Topic shares of a vector or array column as rows named V1, V2, ...

    With a list of topics only these become rows, so the others are never spread.
    """
    kind = df.schema[vector].dataType.typeName()
    array = F.col(vector) if kind == "array" else vector_to_array(vector)
    if topics is not None:
        chosen = [F.struct(F.lit(t).alias(key), F.get(array, int(t[1:]) - 1).alias(value)) for t in topics]
        return df.select(*ids, F.inline(F.array(*chosen)))
    return df.select(*ids, F.posexplode(array).alias("_pos", value)).select(
        *ids, F.concat(F.lit("V"), F.col("_pos") + 1).alias(key), value
    )


def explode_parallel(df: DataFrame, ids: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Rows from array columns that run in parallel."""
    return df.select(*ids, F.inline(F.arrays_zip(*arrays)))
