"""Connected components of a graph given by its edges, in alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import Stages


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node of its component.

    Each round links larger neighbours to a node's smallest neighbour, then does the same for smaller
    ones, until nothing changes; the number of rounds is about the logarithm of the longest chain. Rounds
    are stored, and only a count and a checksum of a round reach the driver.
    """
    current = stages.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while mark != (mark := tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Stored, so that both sides of the join are plain shuffles and Spark can split a hub's rows.
        least = stages.keep(least)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stages.keep(large)
        stages.drop(least)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stages.keep(turned.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        stages.drop(current, large)
        current = after
    ends = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
