"""Mixing sources to target weights by fitting whole documents into each source's budget.

Documents are counted by source and exact length. A source's budget is met in three steps on these
counts: the same share of every length, then the largest lengths that still fit, then, for what is left,
bounded-knapsack dynamic programming over the lengths, which finds the closest sum that whole documents
can reach. The result is a number of documents for each length, and documents are drawn for it in a
seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, free_name, query, table

SEED = 20240101
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
DP_BUDGET = 32_768
BUCKETS = 256


def word_count(text: str) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """Adds `target` to (key, weight, source_size).

    The total of share times all sizes goes out by weight; a source at its most keeps that, and the rest
    is shared anew until none is above. Each round is one aggregate row; a source that is full once stays
    full, so the rounds end. The sources stay on the executors.
    """
    most_words = F.col("source_size") * most
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = None, -1
    while True:
        # A source is full when its most is at or under what its weight gives it at the current level.
        is_full = F.lit(False) if level is None else most_words <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(is_full, most_words)).alias("taken"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("weights"),
            F.count_if(is_full).alias("n"),
        ).first()
        if not row["weights"]:
            return sources.withColumn("target", most_words.cast("double"))
        if row["n"] == full:
            break
        full, level = row["n"], (total - (row["taken"] or 0)) / row["weights"]
    given = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(most_words <= given, most_words.cast("double")).otherwise(given))


def ranked_sources(sources: DataFrame, stages: Stages, weights: tuple[float, ...]) -> DataFrame:
    """Adds `weight`: the weights in turn over the sources by code point, null last.

    Ranks come from range partitions and the number of rows before each, so no task sees all sources.
    """
    null_last = [F.col("key") == "", F.col("key")]
    chunks = stages.keep(sources.repartitionByRange(*null_last).withColumn("chunk", F.spark_partition_id()))
    counts = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chunk
    starts = counts.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("chunk").orderBy(*null_last)
    place = F.col("start") + F.row_number().over(inner) - 1
    turn = F.pmod(place, F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    return chunks.join(starts, "chunk").select("key", "source_size", weight.alias("weight"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length add up to as near the budget as they can.

    Lengths are positive and different. Equal shares of all but dp_budget words first, then the largest
    that fit until at most dp_budget words are left, then dynamic programming on what is left of each
    length. The sum may end above the budget where that is nearer.
    """
    total = int((lengths * counts).sum())
    budget = min(max(budget, 0.0), float(total))
    share = max(0.0, budget - dp_budget) / total if total else 0.0
    taken = np.floor(counts * share).astype(np.int64)
    left = int(round(budget)) - int((lengths * taken).sum())
    order = np.argsort(-lengths)
    for i in order:
        if left <= dp_budget:
            break
        more = min(int(counts[i] - taken[i]), max(0, left - dp_budget // 2) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    if left > 0:
        taken += _knapsack(lengths, counts - taken, left)
    return taken


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the sum of whole documents nearest to the budget, below it on a tie.

    Sums are the bits of one integer. The length that first reached a sum is written down for it, which
    is enough to walk back, as the earlier sum was reached with that length or one before it.
    """
    out = np.zeros_like(counts)
    usable = np.flatnonzero((counts > 0) & (lengths <= 2 * budget))
    limit = 2 * budget
    mask = (1 << (limit + 1)) - 1
    reached, goal = 1, 1 << budget
    by = {}
    for i in usable[np.argsort(-lengths[usable])]:
        if reached & goal:
            break
        length, fresh = int(lengths[i]), reached
        for _ in range(min(int(counts[i]), limit // length)):
            fresh = (fresh << length) & mask & ~reached
            if not fresh:
                break
            reached |= fresh
            bits, base = fresh, 0
            sums = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little"))
            by.update(dict.fromkeys(sums.tolist(), int(i)))
            if reached & goal:
                break
    sums = np.array([0, *by], dtype=np.int64)
    away = np.abs(sums - budget) * 2 + (sums > budget)
    at = int(sums[np.argmin(away)])
    while at:
        out[by[at]] += 1
        at -= int(lengths[by[at]])
    return out


def _fit_groups(dp_budget: int, most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        target, total = float(frame["target"].iloc[0]), int((lengths * counts).sum())
        # Every document goes in as often as the whole source fits into the target; the rest is fitted.
        rounds = min(most, int(target // total))
        extra = fit(lengths, counts, target - rounds * total, dp_budget) if rounds < most else np.zeros_like(counts)
        return frame.assign(rounds=rounds, quota=extra)[["key", "size", "rounds", "quota"]]

    return run


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
    dp_budget: int = DP_BUDGET,
    text: str = "text",
    source: str = "source",
    keep_text: bool = False,
) -> DataFrame:
    """The documents with size, source_size, target, times and taken (words the mix takes, repeats counted).

    Sources in code-point order, null last, have the weights in turn and share `share` times all words; no
    target is above `most` times its source's words. A null or empty text has size 0 and is taken 0 times.
    Equal rows are separate documents; which of them is taken is immaterial. Empty tables give no rows.
    Input columns stay, the text only with keep_text; new names that are taken get underscores before them.

    The documents move once. Those of a (source, size) are spread over buckets by a seeded hash of the
    row; the quota of a size fills one bucket after the other, and the order inside a bucket says which
    go in, so a length or source that a third of all documents have is never in one task.
    """
    stages = Stages(docs.sparkSession)
    names = {n: free_name(docs.columns, n) for n in ("size", "source_size", "target", "times", "taken")}
    kept = [c for c in docs.columns if keep_text or c != text]
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("key"),
        word_count(f"`{text}`").alias("size"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("draw"),
    ).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int"))
    plan = plan_counts(sized, stages, weights, share, most, dp_budget)
    order = Window.partitionBy("key", "size", "bucket").orderBy("draw")
    times = F.col("rounds") + F.when(F.row_number().over(order) <= F.col("room"), 1).otherwise(0)
    placed = sized.join(plan, ["key", "size", "bucket"]).withColumn("times", times)
    taken = (F.col("times") * F.col("size")).cast("long")
    return placed.withColumn("taken", taken).select("row.*", *[F.col(n).alias(m) for n, m in names.items()])


def plan_counts(
    sized: DataFrame, stages: Stages, weights: tuple[float, ...], share: float, most: int, dp_budget: int
) -> DataFrame:
    """For each (key, size, bucket): how often all documents go in (rounds) and how many once more (room)."""
    buckets = stages.keep(sized.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    by_size = stages.keep(buckets.groupBy("key", "size").agg(F.sum("n").alias("n")))
    totals = by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stages.keep(with_targets(stages.keep(ranked_sources(totals, stages, weights)), share, most))
    counted = by_size.where("size > 0").join(targets, "key")
    # A group holds one row for each length a source has, whatever the number of documents.
    quotas = counted.groupBy("key").applyInPandas(_fit_groups(dp_budget, most), "key string, size long, rounds int, quota long")
    joined = buckets.join(stages.keep(quotas), ["key", "size"], "left").join(targets, "key")
    # All documents of a bucket go in until the quota is used up.
    earlier = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    room = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("quota", F.lit(0)) - used))
    rounds = F.coalesce("rounds", F.lit(0))
    return stages.keep(
        joined.select("key", "size", "bucket", rounds.alias("rounds"), room.alias("room"), "source_size", "target")
    )


@query("op4_mixing")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("source", "times")
