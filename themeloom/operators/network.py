"""Firms with several themes and the network of themes that share firms.

Themes are topics, so one firm has at most as many themes as the model has topics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.themes import count_by


def repeated(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups with more than one row, largest first."""
    return count_by(df, by).where("n > 1").orderBy(F.desc("n"), *by)


def _multi_theme(df: DataFrame, firm: str, theme: str) -> DataFrame:
    """Firm, its number of rows, and (theme, rows) of the firms with more than one theme.

    Repeated firms whose count equals the count of one of their repeated themes are to be left out, and
    the two are equal exactly when the firm has that theme only. So counting themes replaces the anti join.
    """
    pairs = count_by(df, [firm, theme], "_rows")
    firms = pairs.groupBy(firm).agg(
        F.sum("_rows").alias("n"), F.collect_list(F.struct(F.col(theme), F.col("_rows"))).alias("_themes")
    )
    kept = firms.where((F.size("_themes") > 1) & F.col(firm).isNotNull())
    return kept.select(firm, "n", F.inline("_themes")).dropna(subset=[theme])


def multi_theme_firms(df: DataFrame, firm: str, theme: str) -> DataFrame:
    """Distinct edges between themes and the firms with several themes."""
    return _multi_theme(df, firm, theme).select(firm, theme, "n")


def theme_firm_count(df: DataFrame, firm: str, theme: str) -> DataFrame:
    """Rows of those firms per theme, repeated rows counted."""
    return _multi_theme(df, firm, theme).groupBy(theme).agg(F.sum("_rows").alias("n"))


def project_bipartite(edges: DataFrame, firm: str, theme: str) -> DataFrame:
    """Theme pairs with the number of firms that have both (src < dst).

    Firms with the same set of themes are counted together first, so pairs come from the few
    different sets and not from every firm.
    """
    sets = edges.select(firm, theme).dropna().groupBy(firm).agg(F.array_sort(F.collect_set(theme)).alias("_set"))
    kinds = sets.where(F.size("_set") > 1).groupBy("_set").agg(F.count(F.lit(1)).alias("_firms"))
    src = kinds.select("_set", "_firms", F.posexplode("_set").alias("_pos", "src"))
    later = F.slice("_set", F.col("_pos") + 2, F.size("_set"))
    pairs = src.select("src", F.explode(later).alias("dst"), "_firms")
    return pairs.groupBy("src", "dst").agg(F.sum("_firms").alias("weight"))


def simplify_edges(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Undirected edges without loops, parallel edges added up."""
    return (
        edges.where(F.col(src) != F.col(dst))
        .groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
        .agg(F.sum(weight).alias("weight"))
    )


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Per theme: the sum of its weights (degree with parallel edges) and the number of neighbours."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("tema"), "weight")
    return ends.groupBy("tema").agg(F.sum("weight").alias("grad"), F.count(F.lit(1)).alias("naboer"))


def bipartite_check(edges: DataFrame, firm: str, theme: str) -> DataFrame:
    """One row: how many names are on both sides, and whether the graph is two-mode."""
    names = edges.select(
        F.explode(
            F.array(
                F.struct(F.col(firm).cast("string").alias("name"), F.lit(1).alias("side")),
                F.struct(F.col(theme).cast("string").alias("name"), F.lit(2).alias("side")),
            )
        ).alias("e")
    ).select("e.*")
    sides = names.dropna().groupBy("name").agg((F.max("side") - F.min("side")).alias("both"))
    return sides.agg(F.coalesce(F.sum("both"), F.lit(0)).cast("long").alias("felles")).withColumn(
        "tomodus", F.col("felles") == 0
    )
