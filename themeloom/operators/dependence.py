"""Partial dependence of a forest on all its variables from one scan of the rows.

A row that meets every condition on the way to a leaf stays in that leaf; one that fails only conditions on
one feature reaches the leaf for those values of the feature that meet them. Counting both kinds of rows by
leaf is all that the mean vote needs, at any value of any feature: rows are never multiplied by grid points.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.forests import Forest, Tree

STAYS = -1  # in place of a feature: the row meets every condition


def _sides(tree: Tree, node: int, values: np.ndarray) -> np.ndarray:
    """Which values of the node's feature go left."""
    members = tree.categories.get(node)
    return np.isin(values, members) if members is not None else values <= tree.threshold[node]


def _reached(tree: Tree, X: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(leaf, feature that alone keeps the rows out or STAYS, rows)."""
    stack = [(0, np.arange(len(X)), np.full(len(X), STAYS))]
    while stack:
        node, rows, free = stack.pop()
        if tree.left[node] == node:
            for f, n in zip(*np.unique(free, return_counts=True), strict=True):
                yield node, int(f), int(n)
            continue
        feature = tree.feature[node]
        goes_left = _sides(tree, node, X[rows, feature])
        for child, meets in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            # A row that already fails on another feature is out for good.
            kept = meets | (free == STAYS) | (free == feature)
            if kept.any():
                stack.append((child, rows[kept], np.where(meets, free, feature)[kept]))


def leaf_reach(forest: Forest, df: DataFrame) -> DataFrame:
    """(tree, leaf, f, n): rows in each leaf (f = -1), and rows that only feature number f keeps out of it.

    One scan; a task sends at most one row for each leaf and each feature on the way to it. Rows count as often as
    they occur; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest.trees)  # bounded by trees and depth
    x = F.array(*[F.col(f).cast("double") for f in forest.features]).alias("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            X = flat.astype(float).reshape(batch.num_rows, -1)
            for t, tree in enumerate(shared.value):
                for leaf, f, n in _reached(tree, X):
                    tally[t, leaf, f] += n
        rows = np.array([(*key, n) for key, n in tally.items()], np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], ["tree", "leaf", "f", "n"])

    parts = df.select(x).mapInArrow(run, "tree long, leaf long, f long, n long")
    return parts.groupBy("tree", "leaf", "f").agg(F.sum("n").alias("n"))


def _levels(df: DataFrame, feature: str) -> list[str]:
    return list(df.schema[feature].metadata.get("ml_attr", {}).get("vals", []))


def grids(df: DataFrame, features: Sequence[str], points: int = 11) -> dict[str, list[float]]:
    """Values for each feature: all levels of an indexed category, else the different quantiles, from one aggregation."""
    named = {f: [float(i) for i in range(len(_levels(df, f)))] for f in features}
    numbers = [f for f in features if not named[f]]
    if numbers:
        steps = [float(i / (points - 1)) for i in range(points)]
        row = df.agg(*[F.percentile(F.col(f).cast("double"), F.lit(steps)).alias(f"q{i}") for i, f in enumerate(numbers)]).first()
        named |= {f: sorted(set(row[f"q{i}"] or [])) for i, f in enumerate(numbers)}
    return named


def _change(tree: Tree, reach: Mapping[tuple[int, int], int], values: Mapping[int, np.ndarray]) -> tuple[int, dict[int, np.ndarray]]:
    """Votes for class 1 as the rows are, and by how many they change at each value of each feature of the tree."""
    votes, change = 0, {}
    stack: list[tuple[int, dict[int, np.ndarray]]] = [(0, {})]
    while stack:
        node, open_at = stack.pop()
        if tree.left[node] != node:
            f = int(tree.feature[node])
            goes_left = _sides(tree, node, values[f])
            before = open_at.get(f, np.ones(len(values[f]), bool))
            stack += [(tree.left[node], {**open_at, f: before & goes_left}), (tree.right[node], {**open_at, f: before & ~goes_left})]
        elif tree.prediction[node] == 1:
            stay = reach.get((node, STAYS), 0)
            votes += stay
            for f, opened in open_at.items():
                moved = np.where(opened, stay + reach.get((node, f), 0), 0) - stay
                change[f] = change.get(f, 0) + moved
    return votes, change


def dependence(forest: Forest, df: DataFrame, grid: Mapping[str, Sequence[float]] | None = None, points: int = 11) -> DataFrame:
    """(variabel, x, niva, andel): mean share of trees that vote for class 1 with a variable at x in every row.

    All variables come from one scan (`leaf_reach`) and the nodes of the trees; the result equals setting the
    variable in all rows and asking every tree. niva is the name of a category's level. grid replaces `grids`; a
    variable without values in it has no rows. Without rows of data there is no share and no row.
    """
    grid = grids(df, forest.features, points) if grid is None else grid
    values = {i: np.array(grid.get(f, []), float) for i, f in enumerate(forest.features)}
    reach: list[dict[tuple[int, int], int]] = [{} for _ in forest.trees]
    # At most a row for each leaf and each feature on the way to it, like the trees themselves.
    for r in leaf_reach(forest, df).collect():
        reach[r.tree][r.leaf, r.f] = r.n
    asked = sum(n for tree in reach for (_, f), n in tree.items() if f == STAYS)  # rows times trees
    parts = [_change(tree, of, values) for tree, of in zip(forest.trees, reach, strict=True)]
    votes = sum(v for v, _ in parts)
    rows = []
    for i, name in enumerate(forest.features if asked else []):
        levels = _levels(df, name)
        moved = sum(change[i] for _, change in parts if i in change)
        for x, n in zip(values[i], np.broadcast_to(votes + moved, len(values[i])), strict=True):
            level = levels[int(x)] if levels and x == int(x) and 0 <= x < len(levels) else None
            rows.append((name, float(x), level, int(n) / asked))
    return df.sparkSession.createDataFrame(rows, "variabel string, x double, niva string, andel double")
