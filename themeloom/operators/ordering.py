"""Running totals and ranks over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.joins import attach, equi_join
from themeloom.sources.scan import cut_lineage


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Adds `<c>_before`: the total of c over the rows that come earlier in the order, within `by`.

    Rows are range-partitioned into chunks, summed per chunk, and each chunk starts from the total of
    the chunks before it. Rows must be unique on `by` and `order`; aggregate to that first.
    """
    by, order = list(by), list(order)
    chunks = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_chunk", F.spark_partition_id()))
    # One row per chunk and group it holds.
    totals = chunks.groupBy(*by, "_chunk").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by, "_chunk", *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_start_{c}") for c in sums]
    )
    inner = Window.partitionBy("_chunk", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = equi_join(chunks, starts, [*by, "_chunk"], "inner", by)
    return joined.select(
        *df.columns,
        *[(F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(f"{c}_before") for c in sums],
    )


def dense_rank_all(df: DataFrame, order: str, out: str = "ord") -> DataFrame:
    """Dense rank of a column over the whole table."""
    distinct = df.select(order).where(F.col(order).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranks = running_totals(distinct, [], [order], ["_one"]).select(order, (F.col("_one_before") + 1).alias(out))
    return attach(df, ranks, [order], "left")
