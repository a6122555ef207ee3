"""Forests whose trees draw the same number of rows of each class, and what the rows that a tree has not seen say.

A digest of the tree and the id decides which rows a tree takes, so draws survive repartitioning and retries and
can be checked row by row. Each tree is fitted by Spark on its own drawn rows, which are stored by
tree; a fitted tree is then a small table of nodes, and one pass over all rows collects the votes of the
trees that did not draw a row, or the fall in their accuracy when a feature is moved.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import digest_number
from themeloom.operators.models import SEED
from themeloom.operators.ordering import running_totals
from themeloom.sources.scan import cut_lineage, save_stage, shared_folder

SHARE = 0.632  # of the smallest class, as a draw with replacement holds of its rows
RANGE = 1 << 32
BUCKET_ROWS = 10_000
FITS = 8  # trees that are fitted at a time
VOTES = "votes_0 long, votes_1 long"


def draws(df: DataFrame, label: str, trees: int, id: str = "id", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(tree, id, label): for each tree the rows of each class with the smallest digests of (tree, id), stored.

    Every class gives ceil(share * rows of the smallest class) rows; the label is 0 or 1, ids are unique, rows
    without a label are left out. Only digests that can be among the smallest are sorted, in range partitions.
    """
    rows = cut_lineage(df.where(F.col(label).isNotNull()).select(id, F.col(label).cast("int").alias("label")))
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return df.sparkSession.createDataFrame([], rows.select(F.lit(0).alias("tree"), id, "label").schema)
    wanted = math.ceil(share * min(sizes.values()))
    number = digest_number("tree", id, seed=seed, modulus=RANGE)
    every = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("number", number)
    # The wanted share and six deviations more; the rare draw that needs more takes all.
    reach = {k: wanted / n + 6 * math.sqrt(wanted) / n + 20 / n for k, n in sizes.items()}
    for limits in (reach, dict.fromkeys(sizes, 1.0)):
        limit = F.lit(0)
        for k, part in limits.items():
            limit = F.when(F.col("label") == k, min(RANGE, math.ceil(part * RANGE))).otherwise(limit)
        near = cut_lineage(every.where(F.col("number") < limit).withColumn("one", F.lit(1).cast("long")))
        counts = near.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= wanted)
        if counts.count() == trees * len(sizes):
            break
    ranked = running_totals(near, ["tree", "label"], ["number", id], ["one"])
    return cut_lineage(ranked.where(F.col("one_before") < wanted).select("tree", id, "label"))


@dataclass(frozen=True)
class Tree:
    """Nodes by number; a leaf is its own child on both sides. `left_of` says which categories go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    categories: dict[int, np.ndarray]
    depth: int

    def classes(self, X: np.ndarray) -> np.ndarray:
        at = np.zeros(len(X), np.int64)
        rows = np.arange(len(X))
        for _ in range(self.depth):
            value = X[rows, self.feature[at]]
            goes_left = value <= self.threshold[at]
            for node, members in self.categories.items():
                here = at == node
                goes_left[here] = np.isin(value[here], members)
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.prediction[at]

    @property
    def used(self) -> np.ndarray:
        return np.unique(self.feature[self.left != np.arange(len(self.left))])


def _tree(nodes: list) -> Tree:
    nodes = sorted(nodes, key=lambda r: r.id)
    n = len(nodes)
    leaf = np.array([r.leftChild < 0 for r in nodes])
    own = np.arange(n)
    split = [r.split for r in nodes]
    number = [s.numCategories < 0 and len(s.leftCategoriesOrThreshold) == 1 for s in split]
    depths = np.zeros(n, np.int64)
    for i, r in enumerate(nodes):  # parents come before their children
        if not leaf[i]:
            depths[[r.leftChild, r.rightChild]] = depths[i] + 1
    return Tree(
        np.where(leaf, 0, [s.featureIndex for s in split]),
        np.array([s.leftCategoriesOrThreshold[0] if x else -np.inf for s, x in zip(split, number, strict=True)]),
        np.where(leaf, own, [r.leftChild for r in nodes]),
        np.where(leaf, own, [r.rightChild for r in nodes]),
        np.array([int(r.prediction) for r in nodes]),
        {i: np.array(s.leftCategoriesOrThreshold) for i, s in enumerate(split) if not leaf[i] and not number[i]},
        int(depths.max()),
    )


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    features: list[str]
    drawn: DataFrame  # (tree, id, label)
    id: str


def fit_forest(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    id: str = "id",
    trees: int = 50,
    mtry: int = 8,
    depth: int = 8,
    share: float = SHARE,
    max_bins: int = 64,
    seed: int = SEED,
) -> Forest:
    """Trees on balanced draws. The forest on the driver is at most trees * 2^(depth + 1) nodes.

    Features are numbers, or indexed categories with their metadata; rows with a missing one must be
    filled or dropped before. A category with more levels than a tree draws rows counts as a number.
    """
    features = list(features)
    spark = df.sparkSession
    drawn = draws(df, label, trees, id, share, seed)
    level_count = lambda f: len(df.schema[f].metadata.get("ml_attr", {}).get("vals", []))
    rows_of_a_tree = drawn.where("tree = 0").count()
    kept = [F.col(f).alias(f, metadata={}) if level_count(f) > rows_of_a_tree else F.col(f) for f in features]
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df.select(id, *kept))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    save_stage(drawn.join(data.select(id, "features"), id).select("tree", "label", "features"), f"{folder}/rows", ["tree"])
    levels = [n for n in map(level_count, features) if n <= rows_of_a_tree]
    meta = data.schema["features"].metadata

    def grow(tree: int) -> None:
        rows = spark.read.parquet(f"{folder}/rows/tree={tree}")
        rows = rows.select("label", F.col("features").alias("features", metadata=meta)).coalesce(8).persist()
        stage = RandomForestClassifier(
            labelCol="label", numTrees=1, bootstrap=False, featureSubsetStrategy=str(mtry), maxDepth=depth,
            maxBins=max(max_bins, *levels), seed=seed + tree,
        )
        stage.fit(rows).write().save(f"{folder}/trees/tree-{tree}")
        rows.unpersist()

    with ThreadPoolExecutor(FITS) as pool:
        list(pool.map(grow, range(trees)))
    saved = spark.read.parquet(f"{folder}/trees/*/data").withColumn(
        "tree", F.regexp_extract(F.input_file_name(), r"/tree-(\d+)/", 1).cast("int")
    )
    nodes: dict[int, list] = {}
    for r in saved.select("tree", "nodeData.*").collect():
        nodes.setdefault(r.tree, []).append(r)
    return Forest([_tree(nodes[t]) for t in range(trees)], features, drawn, id)


def _with_trees(forest: Forest, df: DataFrame, label: str) -> DataFrame:
    """(id, label, x, drawn): the features as an array and the trees that drew the row."""
    taken = forest.drawn.groupBy(forest.id).agg(F.collect_list("tree").alias("drawn"))  # at most one for each tree
    rows = df.select(
        forest.id, F.col(label).cast("int").alias("label"), F.array(*[F.col(f).cast("double") for f in forest.features]).alias("x")
    )
    return rows.join(taken, forest.id, "left").withColumn("drawn", F.coalesce("drawn", F.array().cast("array<int>")))


def _arrays(forest_trees: int, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features, and which trees have not seen which row."""
    X = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
    unseen = np.ones((batch.num_rows, forest_trees), bool)
    drawn = batch.column("drawn")
    unseen[np.repeat(np.arange(batch.num_rows), drawn.value_lengths().to_numpy()), drawn.flatten().to_numpy()] = False
    return X, unseen


def oob_votes(forest: Forest, df: DataFrame, label: str) -> DataFrame:
    """(id, label, votes_0, votes_1, klasse): votes of the trees that did not draw the row.

    The class with more votes, 0 if they tie, NULL if all trees drew the row.
    """
    rows = _with_trees(forest, df, label)
    shared = df.sparkSession.sparkContext.broadcast(forest.trees)  # bounded by trees and depth
    names = [forest.id, "label", "votes_0", "votes_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            X, unseen = _arrays(len(shared.value), batch)
            ones = sum(unseen[:, t] & (tree.classes(X) == 1) for t, tree in enumerate(shared.value)).astype(np.int64)
            zeros = unseen.sum(axis=1) - ones
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(zeros), pa.array(ones)], names)

    kind = df.schema[forest.id].dataType.simpleString()
    votes = rows.mapInArrow(run, f"`{forest.id}` {kind}, label int, {VOTES}")
    winner = F.when(F.col("votes_0") + F.col("votes_1") > 0, (F.col("votes_1") > F.col("votes_0")).cast("int"))
    return votes.withColumn("klasse", winner)


def oob_importance(forest: Forest, df: DataFrame, label: str, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """(variabel, klasse, fall, standardfeil, skalert): fall in accuracy of the trees on rows they have not seen.

    For each tree the values of a feature move one unseen row on, in the hash order of buckets of about
    bucket_rows rows. fall is the mean over trees, standardfeil its standard error, skalert their quotient (NULL
    where the error is 0); klasse is 0, 1 or NULL for both together. One pass over the rows; a task sends one row for
    each tree, feature and class. Trees without an unseen row of a class do not count for it.
    """
    order = digest_number(forest.id, seed=seed + 3, modulus=1 << 31)
    buckets = df.count() // bucket_rows + 1
    rows = _with_trees(forest, df.where(F.col(label).isNotNull()), label)
    rows = rows.withColumns({"_order": order, "_bucket": F.pmod(order, F.lit(buckets)).cast("long")})
    dealt = rows.repartition("_bucket").sortWithinPartitions("_bucket", "_order", forest.id)
    shared = df.sparkSession.sparkContext.broadcast(forest.trees)
    width = len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        # (tree, class, 0: rows, 1: right; then right with each feature moved)
        tally = np.zeros((len(trees), 2, 2 + width), np.int64)

        def count(parts: list[pa.RecordBatch]) -> None:
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            X, unseen = _arrays(len(trees), batch)
            y = batch.column("label").to_numpy()
            for t, tree in enumerate(trees):
                mine = np.flatnonzero(unseen[:, t])
                if not len(mine):
                    continue
                some, marks = X[mine], y[mine]
                right = tree.classes(some) == marks
                tally[t, :, 0] += np.bincount(marks, minlength=2)
                tally[t, :, 1] += np.bincount(marks, right, 2).astype(np.int64)
                tally[t, :, 2:] += np.bincount(marks, right, 2).astype(np.int64)[:, None]
                for f in tree.used:
                    moved = some.copy()
                    moved[:, f] = np.roll(some[:, f], 1)
                    again = tree.classes(moved) == marks
                    tally[t, :, 2 + f] += np.bincount(marks, again, 2).astype(np.int64) - np.bincount(marks, right, 2).astype(np.int64)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column("_bucket")[0].as_py() != keys[a]:
                    count(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            count(held)
        t, k, f = (i.reshape(-1) for i in np.indices((len(trees), 2, width)))
        columns = [t, k, f, tally[t, k, 0], tally[t, k, 1], tally[t, k, 2 + f]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["tree", "klasse", "f", "n", "hits", "moved"])

    parts = dealt.mapInArrow(run, "tree long, klasse long, f long, n long, hits long, moved long")
    summed = parts.groupBy("tree", "klasse", "f").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "moved")])
    whole = summed.groupBy("tree", "f").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "moved")])
    both = cut_lineage(summed.unionByName(whole.withColumn("klasse", F.lit(None).cast("long"))))
    falls = both.where("n > 0").withColumn("fall", (F.col("hits") - F.col("moved")) / F.col("n"))
    stats = falls.groupBy("klasse", "f").agg(
        F.avg("fall").alias("fall"), (F.stddev_samp("fall") / F.sqrt(F.count(F.lit(1)))).alias("standardfeil")
    )
    names = F.array(*[F.lit(x) for x in forest.features])
    return stats.select(
        F.get(names, F.col("f").cast("int")).alias("variabel"), F.col("klasse").cast("int").alias("klasse"), "fall", "standardfeil",
        F.try_divide("fall", F.nullif("standardfeil", F.lit(0.0))).alias("skalert"),
    )
