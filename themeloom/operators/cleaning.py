"""Text assembly, recoding, level order and complete cases."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import LOADING_SCALE, exact, if_else, reaches_mean
from themeloom.operators.distributions import quantiles_by
from themeloom.operators.joins import attach
from themeloom.operators.ordering import dense_rank_all
from themeloom.sources.lookups import as_table


def build_text(df: DataFrame, cols: Sequence[str], out: str = "text", fill: str = " ") -> DataFrame:
    """Fill missing parts, then concatenate them."""
    return df.withColumn(out, F.concat(*[F.coalesce(F.col(c), F.lit(fill)) for c in cols]))


def map_columns(df: DataFrame, cols: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """The same expression on many columns, in one projection."""
    return df.select(*[f(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def select_by_prefix(df: DataFrame, prefix: str, also: Sequence[str] = ()) -> DataFrame:
    return df.select(*also, *[c for c in df.columns if c.startswith(prefix) and c not in also])


def recode(
    df: DataFrame,
    col: str,
    mapping: DataFrame | Mapping[str, str],
    out: str,
    default: str = "passthrough",
    null_codes: Sequence[str] = (),
) -> DataFrame:
    """Replace codes by the labels of a (code, label) table.

    Codes outside the table keep their value or become NULL; null_codes always become NULL.
    """
    if isinstance(mapping, Mapping):
        table = as_table(df.sparkSession, dict(mapping)).toDF(col, "_label")
        joined = df.join(F.broadcast(table), col, "left")
    else:
        joined = attach(df, mapping.toDF(col, "_label"), [col], "left", bounded=True)
    value = F.col("_label") if default == "null" else F.coalesce("_label", col)
    if null_codes:
        value = F.when(~F.coalesce(F.col(col).isin(list(null_codes)), F.lit(False)), value)
    return joined.withColumn(out, value).drop("_label")


def binary_outcome(df: DataFrame, col: str, positive: str, negative: str, out: str) -> DataFrame:
    """Two outcome classes; a missing outcome stays missing."""
    return df.withColumn(out, if_else(F.col(col) == positive, F.lit(positive), F.lit(negative)))


def dichotomise_wide(
    df: DataFrame, cols: Sequence[str], na_rm: bool = True, scale: int = LOADING_SCALE
) -> DataFrame:
    """Each column becomes 1 at or above its own mean and 0 below; NULL stays NULL.

    All means come from one aggregation; its single row goes into the plan as constants. The table is
    read twice, so pass a stored one.
    """
    stats = df.agg(
        *[F.sum(exact(df, c, scale)).alias(f"s_{c}") for c in cols],
        *[F.count(c).alias(f"n_{c}") for c in cols],
        F.count(F.lit(1)).alias("_rows"),
    ).first()

    def flag(c: str) -> Column:
        n, total = stats[f"n_{c}"], stats[f"s_{c}"]
        if total is None or (not na_rm and n < stats["_rows"]):
            return F.lit(None).cast("int")
        return if_else(reaches_mean(exact(df, c, scale), F.lit(total), F.lit(n)), 1, 0).cast("int")

    return df.select(*[flag(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def level_order(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Ordinal column `<col>_ord` from an ordered list; values outside it have none and become NULL."""
    places = {level: str(i) for i, level in enumerate(levels, 1)}
    table = as_table(df.sparkSession, places).select(
        F.col("code").alias(col), F.col("label").cast("long").alias(f"{col}_ord")
    )
    joined = df.join(F.broadcast(table), col, "left")
    return joined.withColumn(col, F.when(F.col(f"{col}_ord").isNotNull(), F.col(col)))


def reorder_levels(df: DataFrame, col: str, value: str) -> DataFrame:
    """One row per level with its median value and its place in the order of the medians."""
    medians = quantiles_by(df, [col], value, {"median": 0.5})
    return dense_rank_all(medians.withColumn("median", F.round("median", 9)), "median")


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def fill_missing_label(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))
