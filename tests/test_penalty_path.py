"""The whole path of ridge and lasso logits against plain solvers and Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from themeloom.functions import digest_number
from themeloom.operators import models, penalty_path

NAMES = ["a", "b", "c", "d", "flat"]
TYPES = "id long, label int, a double, b double, c double, d double, flat double"


def planted(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1] + [0, 5, 1, 0]
    y = rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.4 * (x[:, 1] - 5))))
    return [(i, int(t), *map(float, r), 1.0) for i, (r, t) in enumerate(zip(x, y, strict=True))]


@pytest.mark.parametrize("kind", ["ridge", "lasso"])
def test_path_equals_spark_on_every_training_set(spark, kind):
    df = spark.createDataFrame(planted(), TYPES).repartition(3).cache()
    penalties = [0.3, 0.03, 0.001]
    model = penalty_path.fit_path(kind, df, "label", NAMES, penalties, folds=3, tol=1e-8)
    assert model.avvik.max() <= 1e-8
    whole = VectorAssembler(inputCols=NAMES, outputCol="v").transform(df).coalesce(1).cache()
    fold = digest_number("id", seed=0, modulus=3)
    for g in (0, 3):
        rows = whole.where(fold != g) if g < 3 else whole
        for i, p in enumerate(penalties):
            plain = LogisticRegression(
                featuresCol="v", labelCol="label", regParam=p, elasticNetParam=float(kind == "lasso"),
                fitIntercept=kind == "ridge", maxIter=200, tol=1e-11,
            ).fit(rows)
            assert np.allclose(model.coefficients[g, i], plain.coefficients.toArray(), atol=2e-4)
            assert abs(model.intercepts[g, i] - plain.intercept) < 2e-3
            if g < 3:
                held = plain.transform(whole.where(fold == g))
                assert model.feil[g, i] == pytest.approx(held.agg(F.avg((F.col("prediction") != F.col("label")).cast("int"))).first()[0])
    scored = model.transform(df, place=2).select(F.col("probability"), "prediction", *NAMES).collect()
    for r in scored[:20]:
        margin = model.coefficients[-1, 2] @ [r[n] for n in NAMES] + model.intercepts[-1, 2]
        assert r["probability"][1] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_scans_do_not_grow_with_folds_and_points(spark):
    df = spark.createDataFrame(planted(), TYPES).coalesce(2).cache()
    few = penalty_path.fit_path("ridge", df, "label", NAMES, [0.1, 0.001], folds=2)
    many = penalty_path.fit_path("ridge", df, "label", NAMES, list(np.geomspace(0.1, 0.001, 15)), folds=6)
    assert many.avvik.max() <= 1e-6 and many.scans <= few.scans + 6


def test_sparse_and_dense_vectors_give_the_same(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        x = np.where(rng.random(30) < 0.2, rng.normal(size=30), 0.0)
        y = int(x[:5].sum() + 0.3 * rng.normal() > 0)
        x = np.zeros(30) if i == 7 else x  # a row without entries
        nonzero = np.flatnonzero(x)
        vector = Vectors.sparse(30, nonzero.tolist(), x[nonzero].tolist()) if i % 2 else Vectors.dense(x)
        rows.append((i, y, vector, *map(float, x)))
    names = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ["id", "label", "v", *names]).cache()
    for kind in ("ridge", "lasso"):
        one = penalty_path.fit_path(kind, df, "label", ["v"], [0.1, 0.02], folds=2, tol=1e-8)
        two = penalty_path.fit_path(kind, df, "label", names, [0.1, 0.02], folds=2, tol=1e-8)
        assert np.allclose(one.coefficients, two.coefficients, atol=1e-5)
        assert np.array_equal(one.feil, two.feil)
        if kind == "lasso":
            assert 0 < (one.coefficients[-1, 0] != 0).sum() < 30
        ours = [r[0][1] for r in one.transform(df.orderBy("id")).select("probability").collect()]
        theirs = [r[0][1] for r in two.transform(df.orderBy("id")).select("probability").collect()]
        assert np.allclose(ours, theirs, atol=1e-5)


def test_screening_keeps_the_solution(spark):
    """Cells beyond a block, of which the lasso drops nearly all."""
    rng = np.random.default_rng(3)
    width = penalty_path.BLOCK + 500
    rows = []
    for i in range(150):
        places = np.unique(rng.integers(3, width, 20))
        x = np.r_[rng.normal(size=2), rng.normal(size=len(places))]
        label = int(x[0] - x[1] + 0.5 * rng.normal() > 0)
        rows.append((i, label, Vectors.sparse(width, [0, 1, *places.tolist()], x.tolist())))
    df = spark.createDataFrame(rows, ["id", "label", "v"]).cache()
    model = penalty_path.fit_path("lasso", df, "label", ["v"], [0.15, 0.08], folds=2, tol=1e-6)
    # The last scan checks the condition for all features, also those that were screened.
    assert model.avvik.max() <= 1e-5
    leading = np.argsort(-np.abs(model.coefficients[-1, 0]))[:2]
    assert set(leading.tolist()) == {0, 1}


def test_odd_tables(spark):
    df = spark.createDataFrame(planted(40), TYPES)
    with pytest.raises(ValueError):
        penalty_path.fit_path("ridge", df.limit(0), "label", NAMES, [0.1], folds=2)
    missing = df.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    with pytest.raises(Exception, match="missing"):
        penalty_path.fit_path("ridge", missing, "label", NAMES, [0.1], folds=2)
    same = penalty_path.fit_path("ridge", df.withColumn("label", F.lit(1)), "label", NAMES, [0.1], folds=2)
    assert np.isfinite(same.coefficients).all() and same.feil.max() == 0
    twice = penalty_path.fit_path("ridge", df.unionByName(df), "label", NAMES, [0.1], folds=2, tol=1e-9)
    once = penalty_path.fit_path("ridge", df, "label", NAMES, [0.1], folds=2, tol=1e-9)
    # Repeated rows count twice; only the deviation's n - 1 tells them apart.
    assert np.allclose(twice.coefficients, once.coefficients, atol=2e-2)
    chosen = models.fit_classifier("ridge", df.cache(), "label", NAMES, folds=2, points=3)
    assert models.cv_curve(chosen, spark).count() == 3
    assert models.score(chosen, df, "label").count() == 40


def test_one_task_for_each_core_of_many_small_partitions(spark):
    """The sums of a scan do not grow with the rows, and few rows make one task."""
    few = spark.range(3_000).repartition(40)
    assert models.sized(few, models.PATH_ROWS, 8).rdd.getNumPartitions() == 4
    many = spark.range(30_000).repartition(40)
    assert models.sized(many, models.PATH_ROWS, 8).rdd.getNumPartitions() == 8


def test_sums_of_entries_and_columns():
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((7, 5)) < 0.5, rng.normal(size=(7, 5)), 0.0)
    dense[3] = 0.0  # a row without entries
    rows, places = np.nonzero(dense)
    starts = np.r_[0, np.cumsum(np.bincount(rows, minlength=7))]
    weights, parts, total = rng.normal(size=(3, 5)), rng.normal(size=(7, 3)), np.ones((3, 5))
    assert np.allclose(penalty_path._products(starts, places, dense[rows, places], weights), dense @ weights.T)
    penalty_path._add_columns(total, starts, places, dense[rows, places], parts)
    assert np.allclose(total, 1 + parts.T @ dense)
