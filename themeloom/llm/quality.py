"""Quality from document statistics: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a short vector of statistics. Random Fourier features turn a linear model on it
into an approximation of a Gaussian kernel. Every task sums its part of the normal equations, the sums
are added up in a tree, and only the small system is solved on the driver. Equations are summed by fold,
so each fold is scored by a model of the others; isotonic regression on those scores gives probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, free_name, query, table
from themeloom.llm.calibration import isotonic
from themeloom.llm.toxicity import is_held_out

FEATURES = 256
WIDTH = 1.0  # of the kernel, times the root of the number of statistics
RIDGE = 1e-3
FOLDS = 3
BINS = 2_000
SEED = 11
BATCH = 256

STATISTICS = [
    "log_chars", "log_words", "word_length", "word_length_spread", "letters", "digits", "upper", "spaces", "symbols",
    "bars", "marks", "commas", "stops", "distinct_words", "short_words", "long_words", "words_ending_in_symbols",
    "upper_words", "log_lines", "line_length", "repeated_lines", "repeated_triples", "compression", "beyond_ascii",
]
SYMBOL_END = re.compile(r"[^\w\s.,;:!?|]+(?:\s|$)")
UPPER_WORD = re.compile(r"(?<!\w)[^\W\d_a-z]{2,}(?!\w)")


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode()
    n = len(text)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    lengths = np.array([len(x) for x in words]) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = len({hash(x) for x in zip(words, words[1:], words[2:], strict=False)})
    lower, upper = hist[97:123].sum(), hist[65:91].sum()
    plain = lower + upper + hist[48:58].sum() + hist[9:14].sum() + hist[32]
    return [
        np.log1p(n),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        (lower + upper) / len(data),
        hist[48:58].sum() / len(data),
        upper / max(1, lower + upper),
        (hist[9:14].sum() + hist[32]) / len(data),
        (hist[:128].sum() - plain) / len(data),
        hist[124] / w,
        (hist[33] + hist[63]) / w,
        hist[44] / w,
        hist[46] / w,
        len(set(words)) / w,
        (lengths <= 3).mean(),
        (lengths >= 12).mean(),
        len(SYMBOL_END.findall(text)) / w,
        len(UPPER_WORD.findall(text)) / w,
        np.log1p(len(lines)),
        np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - triples / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        len(zlib.compress(data, 1)) / len(data),
        hist[128:].sum() / len(data),
    ]


def with_statistics(docs: DataFrame, text: str, out: str) -> DataFrame:
    """All columns but the text, and its statistics; no shuffle."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.drop(text).withColumn(out, F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))], [*kept, out])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Kernel:
    """Standardised statistics to random Fourier features, with a constant at the end."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def drawn(mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        scale = 1 / (width * np.sqrt(len(mean)))
        return Kernel(mean, spread, rng.normal(0, scale, (len(mean), features)), rng.uniform(0, 2 * np.pi, features))

    def __call__(self, values: np.ndarray) -> np.ndarray:
        z = np.clip((values - self.mean) / self.spread, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(z), 1))], 1)


@dataclass(frozen=True)
class QualityModel:
    kernel: Kernel
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]  # scores and the probabilities they stand for, both rising

    def probability(self, values: np.ndarray) -> np.ndarray:
        return np.interp(self.kernel(values) @ self.weights, *self.steps)


def normal_equations(rows: DataFrame, kernel: Kernel, folds: int) -> np.ndarray:
    """For each fold the sum of z'z, z'y and the number of rows, from (statistics, y, fold).

    A task gives one row of fixed size, and those are added up in a tree, a task never adding more than 32.
    """
    shared = rows.sparkSession.sparkContext.broadcast(kernel)
    size = kernel.directions.shape[1] + 1
    schema = "sums binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = shared.value(_matrix(batch.column("statistics")))
            y, fold = batch.column("y").to_numpy().astype(float), batch.column("fold").to_numpy()
            for k in range(folds):
                at = z[fold == k]
                total[k, :, :size] += at.T @ at
                total[k, :, size] += at.T @ y[fold == k]
                total[k, 0, size + 1] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(folds * size * (size + 2))
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(partial, schema)
    while parts > 32:
        parts = -(-parts // 32)
        sums = sums.repartition(parts).mapInArrow(added, schema)
    out = np.zeros(folds * size * (size + 2))
    for row in sums.toLocalIterator():
        out += np.frombuffer(row["sums"])
    return out.reshape(folds, size, size + 2)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from summed equations; the constant is not shrunk."""
    size = sums.shape[0]
    n = max(1.0, sums[0, size + 1])
    shrink = ridge * n * np.eye(size) / size
    shrink[-1, -1] = 1e-9
    return np.linalg.solve(sums[:, :size] + shrink, sums[:, size])


def train(measured: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, folds: int = FOLDS, seed: int = SEED) -> QualityModel | float:
    """A model from (doc_id, statistics, y) with y 0 or 1; with one class or none, the smoothed share.

    All rows count. What reaches the driver is bounded: one row of moments, at most 32 sums of fixed size,
    and at most BINS + 1 rounded scores.
    """
    n_stats = len(STATISTICS)
    moments = measured.agg(
        F.count(F.lit(1)),
        F.sum("y"),
        *[F.avg(F.col("statistics")[i]) for i in range(n_stats)],
        *[F.stddev_pop(F.col("statistics")[i]) for i in range(n_stats)],
    ).first()
    n, ones = moments[0], moments[1] or 0
    if ones in (0, n):
        return (ones + 0.5) / (n + 1)
    mean, spread = np.array(moments[2 : 2 + n_stats]), np.array(moments[2 + n_stats :])
    kernel = Kernel.drawn(mean, np.where(spread > 1e-9, spread, 1.0), features, width, seed)
    rows = measured.select(
        "statistics", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(folds)).cast("int").alias("fold")
    )
    sums = normal_equations(rows, kernel, folds)
    by_fold = np.stack([solve(sums.sum(0) - sums[k], ridge) for k in range(folds)])
    shared = measured.sparkSession.sparkContext.broadcast((kernel, by_fold))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            if batch.num_rows:
                fold = batch.column("fold").to_numpy()
                scores = (known(_matrix(batch.column("statistics"))) * weights[fold]).sum(1)
                places = np.round(np.clip(scores, -0.5, 1.5) * (BINS / 2)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(places), batch.column("y")], ["place", "y"])

    binned = rows.mapInArrow(crossed, "place int, y int").groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("h"))
    points = sorted(binned.collect())  # at most BINS + 1 rows
    steps = isotonic(np.array([p[0] / (BINS / 2) for p in points]), np.array([p[1] for p in points], float), np.array([p[2] for p in points], float))
    return QualityModel(kernel, solve(sums.sum(0), ridge), steps)


def score(measured: DataFrame, model: QualityModel | float, out: str) -> DataFrame:
    """The rows with their probability in place of the statistics."""
    if isinstance(model, float):
        return measured.withColumn(out, F.lit(model)).drop("statistics")
    shared = measured.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in measured.columns if c != "statistics"]
    schema = measured.drop("statistics").withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(_matrix(batch.column("statistics"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(p)], [*kept, out])

    return measured.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """All columns but the text, and the probability that `quality` is 1, learned from (doc_id, quality).

    Null and empty texts have statistics of zero and a score like any other. Of labels that contradict
    each other for an id, 1 counts; rows with a null id or label are not learned from. Every row stays; a
    column called like `out` stays and the new one gets underscores before it. The texts are read once and
    do not move; their statistics are stored.
    """
    stages = Stages(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id"), F.col(f"`{text}`"))
    measured = stages.keep(with_statistics(slim, text, "statistics"))
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    learned = stages.keep(measured.select("doc_id", "statistics").join(one, "doc_id"))
    model = train(learned)
    stages.drop(learned)
    return score(measured.drop("doc_id"), model, "p").select("row.*", F.col("p").alias(free_name(kept, out)))


@query("op7_quality")
def op7(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = docs.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "text")
    scored = score_quality(rows, labels.where(~is_held_out("doc_id", 4, 2)))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
