"""Confusion statistics, ROC curve and AUC."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.ordering import running_totals


def confusion(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Counts of predicted by true class, incomplete rows left out."""
    return df.dropna("any", subset=[pred, ref]).groupBy(pred, ref).agg(F.count(F.lit(1)).alias("n"))


def confusion_stats(cells: DataFrame, pred: str, ref: str, positive=1) -> DataFrame:
    """One row of statistics from the cells of a two-class table."""

    def cell(p: bool, r: bool):
        p_ok = F.col(pred) == positive if p else F.col(pred) != positive
        r_ok = F.col(ref) == positive if r else F.col(ref) != positive
        return F.coalesce(F.sum(F.when(p_ok & r_ok, F.col("n"))), F.lit(0)).cast("double")

    four = cells.agg(
        cell(True, True).alias("tp"),
        cell(True, False).alias("fp"),
        cell(False, True).alias("fn"),
        cell(False, False).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    accuracy = F.try_divide(tp + tn, n)
    chance = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sensitivity = F.try_divide(tp, tp + fn)
    specificity = F.try_divide(tn, tn + fp)
    stats = {
        "accuracy": accuracy,
        "no_information_rate": F.try_divide(F.greatest(tp + fn, fp + tn), n),
        "kappa": F.try_divide(accuracy - chance, 1 - chance),
        "mcnemar": F.try_divide(F.pow(F.abs(fp - fn) - 1, F.lit(2.0)), fp + fn),
        "sensitivity": sensitivity,
        "specificity": specificity,
        "ppv": F.try_divide(tp, tp + fp),
        "npv": F.try_divide(tn, tn + fn),
        "prevalence": F.try_divide(tp + fn, n),
        "detection_rate": F.try_divide(tp, n),
        "detection_prevalence": F.try_divide(tp + fp, n),
        "balanced_accuracy": (sensitivity + specificity) / 2,
    }
    return four.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(name) for name, c in stats.items()])


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for m in range(2000, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    return front / value


def accuracy_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial confidence interval of a share, from two numbers."""

    def at_least(p: float, k: int) -> float:
        return _beta_share(p, k, n - k + 1)

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    rest = (1 - level) / 2
    lower = 0.0 if hits == 0 else solve(lambda p: at_least(p, hits) < rest)
    upper = 1.0 if hits == n else solve(lambda p: 1 - at_least(p, hits + 1) > rest)
    return lower, upper


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, counted before the shuffle."""
    known = df.dropna("any", subset=[label, score])
    return known.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """True and false positive rate when rows at or above each distinct score count as positive."""
    counts = _by_score(df, label, score)
    totals = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("t")).scalar()
    run = running_totals(counts, [], ["score"], ["pos", "neg"])
    tp = totals.getField("pos") - F.col("pos_before")
    fp = totals.getField("neg") - F.col("neg_before")
    return run.select(
        F.col("score").alias("terskel"),
        F.round(F.try_divide(tp.cast("double"), totals.getField("pos").cast("double")), 6).alias("tpr"),
        F.round(F.try_divide(fp.cast("double"), totals.getField("neg").cast("double")), 6).alias("fpr"),
    )


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: share of positive-negative pairs in which the positive has the higher score, ties half."""
    counts = _by_score(df, label, score)
    run = running_totals(counts, [], ["score"], ["pos", "neg"])
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return run.agg(F.round(F.try_divide(won, pairs), 9).alias("auc"))


def model_comparison(scored: Mapping[str, DataFrame]) -> DataFrame:
    """AUC per model."""
    result = None
    for name, frame in scored.items():
        row = auc(frame).select(F.lit(name).alias("modell"), "auc")
        result = row if result is None else result.unionByName(row)
    return result
