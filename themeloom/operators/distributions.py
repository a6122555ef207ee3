"""Quantiles, summaries, kernel densities and box-plot statistics per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import exact
from themeloom.operators.joins import attach, equi_join
from themeloom.operators.ordering import running_totals
from themeloom.sources.scan import cut_lineage

MAX_DISTINCT = 1_000_000


def quantiles_by(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], max_distinct: int = MAX_DISTINCT
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group with a value.

    Equal values are counted first. Groups with at most max_distinct different values are finished by
    `percentile` on the counts; beyond that the ranks come from running totals over range partitions.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts)
    widest = counts.groupBy(*by).count().agg(F.max("count").alias("m")).first().m or 0
    if widest <= max_distinct:
        points = F.array(*[F.lit(p) for p in probs.values()])
        packed = counts.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), points, F.col("_n")).alias("_q"))
        return packed.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    return ranked_quantiles(counts, by, value, probs)


def ranked_quantiles(counts: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from (by, value, _n) rows by their place in the order."""
    by = list(by)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = attach(running_totals(counts, by, [value], ["_n"]), totals, by, "inner", null_safe=by, bounded=True) if by else (
        running_totals(counts, by, [value], ["_n"]).withColumn("_total", totals.select("_total").scalar())
    )

    def at(place):
        inside = (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    columns = []
    for name, p in probs.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        columns += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
    return placed.groupBy(*by).agg(*columns).select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in probs
        ],
    )


def summary_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum per group, rounded to nine digits."""
    by = list(by)
    fixed = df.select(*by, exact(df, value).alias(value))
    basics = fixed.groupBy(*by).agg(
        F.min(value).cast("double").alias("min"),
        (F.sum(value).cast("double") / F.count(value)).alias("mean"),
        F.max(value).cast("double").alias("max"),
        F.count(value).alias("n"),
    )
    quartiles = quantiles_by(fixed, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # Both sides hold one row per group.
    joined = equi_join(basics, quartiles, by, "left", by) if by else basics.withColumns(
        {q: quartiles.select(q).scalar() for q in ("q1", "median", "q3")}
    )
    numbers = ("min", "q1", "median", "mean", "q3", "max")
    return joined.select(*by, "n", *[F.round(c, 9).alias(c) for c in numbers])


def stack_summaries(frames: Mapping[str, DataFrame], value: str, label: str = "utvalg") -> DataFrame:
    """The overall summary of several tables, one row each."""
    result = None
    for name, frame in frames.items():
        row = summary_by(frame, [], value).select(F.lit(name).alias(label), "*")
        result = row if result is None else result.unionByName(row)
    return result


def kde(df: DataFrame, by: str, value: str, points: int = 512, bins: int = 512) -> DataFrame:
    """Gaussian kernel density per group on a common grid over the whole range.

    Values are spread over `bins` equal cells by linear weights first, so the kernel is evaluated
    bins x points times per group whatever the number of rows. Groups without a spread have no density.
    """
    data = df.select(by, F.col(value).cast("double").alias("_x")).dropna()
    edges = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("edges")).scalar()
    low, high = edges.getField("lo"), edges.getField("hi")
    step = (high - low) / F.lit(bins - 1)

    quartiles = quantiles_by(data, [by], "_x", {"_q1": 0.25, "_q3": 0.75})
    spread = data.groupBy(by).agg(F.count("_x").alias("n"), F.stddev_samp("_x").alias("_sd"))
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    width = F.when(iqr > 0, F.least("_sd", iqr)).otherwise(F.col("_sd"))
    bandwidth = (
        equi_join(spread, quartiles, [by], "inner", [])
        .withColumn("bw", 0.9 * width * F.pow("n", F.lit(-0.2)))
        .where(F.col("bw") > 0)
        .select(by, "n", "bw")
    )

    place = data.withColumn("_at", F.try_divide(F.col("_x") - low, step))
    place = place.withColumn("_cell", F.least(F.floor("_at"), F.lit(bins - 2)))
    share = F.col("_at") - F.col("_cell")
    cells = place.select(
        by,
        F.explode(
            F.array(
                F.struct(F.col("_cell").alias("cell"), (1 - share).alias("w")),
                F.struct((F.col("_cell") + 1).alias("cell"), share.alias("w")),
            )
        ).alias("c"),
    )
    weights = cells.groupBy(by, "c.cell").agg(F.sum("c.w").alias("w"))
    # At most `bins` entries per group.
    packed = weights.groupBy(by).agg(F.collect_list(F.struct("cell", "w")).alias("_cells"))
    grid = (
        equi_join(packed, bandwidth, [by], "inner", [])
        .select(
            by,
            "n",
            "bw",
            F.array_sort("_cells").alias("_cells"),
            F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("punkt"),
        )
        .repartition(by, "punkt")
        .withColumns({"_low": low, "_step": step, "_point": low + F.col("punkt") * (high - low) / F.lit(points - 1)})
    )
    centre = lambda c: F.col("_low") + c["cell"] * F.col("_step")
    heights = F.aggregate(
        "_cells",
        F.lit(0.0),
        lambda total, c: total + c["w"] * F.exp(-0.5 * F.pow((F.col("_point") - centre(c)) / F.col("bw"), F.lit(2.0))),
    )
    density = heights / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi()))
    return grid.select(by, F.col("punkt").cast("long").alias("punkt"), F.round("_point", 6).alias("x"), F.round(density, 6).alias("tetthet"))


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value inside the fences, and the number of values outside."""
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(*by, value)
    boxes = quantiles_by(data, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * whisker
    x = F.col(value).cast("double")
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        attach(data, boxes, by, "inner", null_safe=by, bounded=True)
        .groupBy(*by)
        .agg(
            *[F.round(F.first(q), 9).alias(q) for q in ("q1", "median", "q3")],
            F.round(F.min(F.when(inside, x)), 9).alias("nedre"),
            F.round(F.max(F.when(inside, x)), 9).alias("ovre"),
            F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("utliggere"),
        )
    )
