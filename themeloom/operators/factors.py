"""Principal components, varimax rotation and correlations of theme columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Components:
    """loadings (variabel, komponent, ladning), variance (komponent, ...) and scores (id, PC1, ...)."""

    loadings: DataFrame
    variance: DataFrame
    scores: DataFrame
    matrix: np.ndarray


def _standardised(df: DataFrame, cols: Sequence[str], id: str) -> DataFrame:
    """Standardised columns as one vector; rows with a missing value are left out."""
    numbers = df.select(id, *[F.col(c).cast("double").alias(c) for c in cols]).dropna("any", subset=list(cols))
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(numbers)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_z")
    return scaler.fit(vectors).transform(vectors).select(id, "_z")


def _scores(z: DataFrame, matrix: np.ndarray, id: str, prefix: str) -> DataFrame:
    """Products of the standardised rows with the columns of a small matrix."""
    values = vector_to_array("_z")
    columns = [
        sum((values[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0)).alias(f"{prefix}{j}")
        for j, weights in enumerate(matrix.T, 1)
    ]
    return z.select(id, *columns)


def _long_loadings(df: DataFrame, cols: Sequence[str], matrix: np.ndarray, prefix: str) -> DataFrame:
    rows = [
        (c, f"{prefix}{j + 1}", float(matrix[i, j])) for i, c in enumerate(cols) for j in range(matrix.shape[1])
    ]
    return df.sparkSession.createDataFrame(rows, "variabel string, komponent string, ladning double")


def pca(df: DataFrame, cols: Sequence[str], id: str = "id", k: int | None = None) -> Components:
    """Components of the correlation matrix; the largest loading of each component is positive."""
    k = k or len(cols)
    z = _standardised(df, cols, id)
    model = PCA(k=k, inputCol="_z", outputCol="_pc").fit(z)
    matrix = model.pc.toArray()
    largest = matrix[np.abs(matrix).argmax(axis=0), np.arange(k)]
    matrix = matrix * np.where(largest < 0, -1.0, 1.0)
    shares = model.explainedVariance.toArray()
    rows = [
        (f"PC{j + 1}", float(np.sqrt(max(s, 0.0) * len(cols))), float(s), float(shares[: j + 1].sum()))
        for j, s in enumerate(shares)
    ]
    variance = df.sparkSession.createDataFrame(
        rows, "komponent string, standardavvik double, andel double, kumulativ double"
    )
    return Components(_long_loadings(df, cols, matrix, "PC"), variance, _scores(z, matrix, id, "PC"), matrix)


def varimax(loadings: np.ndarray, tol: float = 1e-8, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Kaiser's rotation with row normalisation: rotated loadings and the rotation.

    Each step rotates one pair of columns by the angle that is best for that pair.
    """
    length = np.sqrt((loadings**2).sum(axis=1))
    length[length == 0] = 1.0
    rotated = loadings / length[:, None]
    rotation = np.eye(loadings.shape[1])
    for _ in range(rounds):
        moved = 0.0
        for a, b in combinations(range(rotated.shape[1]), 2):
            x, y = rotated[:, a], rotated[:, b]
            u, v = x * x - y * y, 2 * x * y
            top = 2 * ((u * v).sum() - u.sum() * v.sum() / len(u))
            bottom = (u * u - v * v).sum() - (u.sum() ** 2 - v.sum() ** 2) / len(u)
            angle = np.arctan2(top, bottom) / 4
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            rotated[:, [a, b]] = rotated[:, [a, b]] @ turn
            rotation[:, [a, b]] = rotation[:, [a, b]] @ turn
            moved = max(moved, abs(angle))
        if moved < tol:
            break
    return rotated * length[:, None], rotation


def rotated_loadings(df: DataFrame, cols: Sequence[str], components: Components) -> DataFrame:
    rotated, _ = varimax(components.matrix)
    return _long_loadings(df, cols, rotated, "RC")


def rotated_scores(df: DataFrame, cols: Sequence[str], components: Components, id: str = "id") -> DataFrame:
    """Scores of all rows on the rotated components."""
    rotated, _ = varimax(components.matrix)
    return _scores(_standardised(df, cols, id), rotated, id, "RC")


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, from one aggregation."""
    numbers = {c: F.col(c).cast("double") for c in cols}
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(numbers[a], numbers[b]), 6).alias("r"))
        for a, b in combinations(cols, 2)
    ]
    return df.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))
