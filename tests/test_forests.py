"""Balanced draws, votes of unseen trees and their importance, against plain Python and planted features."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import dependence, forests, models

TREES = 12


@pytest.fixture(scope="module")
def planted(spark):
    """The label follows x and the category; z is noise, and one class is rare."""
    rng = np.random.default_rng(8)
    x, z, k = rng.normal(size=900), rng.normal(size=900), rng.integers(0, 3, 900)
    y = (x + 1.5 * (k == 2) + 0.3 * rng.normal(size=900) > 1.2).astype(int)
    rows = [(int(i), int(y[i]), float(x[i]), float(z[i]), "abc"[k[i]]) for i in range(900)]
    frame = models.index_categories(spark.createDataFrame(rows, "id long, label int, x double, z double, k string"), ["k"])
    return frame.repartition(5).persist()


@pytest.fixture(scope="module")
def forest(planted):
    return forests.fit_forest(planted, "label", ["x", "z", "k_ix"], trees=TREES, mtry=2, depth=5)


def test_draws_are_the_smallest_digests_of_each_class(planted, forest):
    labels = {r.id: r.label for r in planted.collect()}
    wanted = math.ceil(0.632 * min(Counter(labels.values()).values()))
    got = {(r.tree, r.id) for r in forest.drawn.collect()}
    digest = lambda t, i: int(hashlib.md5(f"{models.SEED}|{t}|{i}".encode()).hexdigest()[:8], 16)
    expected = set()
    for t in range(TREES):
        for k in (0, 1):
            ids = sorted((i for i in labels if labels[i] == k), key=lambda i: (digest(t, i), i))
            expected |= {(t, i) for i in ids[:wanted]}
    assert got == expected


def test_votes_come_from_unseen_trees(planted, forest):
    rows = planted.select("id", "label", "x", "z", "k_ix").collect()
    X = np.array([[r.x, r.z, r.k_ix] for r in rows])
    classes = np.stack([t.classes(X) for t in forest.trees], 1)
    drawn = {(r.tree, r.id) for r in forest.drawn.collect()}
    votes = {r.id: (r.votes_0, r.votes_1, r.klasse) for r in forests.oob_votes(forest, planted, "label").collect()}
    assert len(votes) == len(rows)
    for r, row in zip(rows, classes, strict=True):
        unseen = [int(c) for t, c in enumerate(row) if (t, r.id) not in drawn]
        zeros, ones = unseen.count(0), unseen.count(1)
        assert votes[r.id] == (zeros, ones, None if not unseen else int(ones > zeros))
    right = sum(votes[r.id][2] == r.label for r in rows)
    assert right / len(rows) > 0.85


def test_trees_are_those_that_spark_fitted(spark, planted):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x", "z", "k_ix"], outputCol="features").transform(planted)
    model = RandomForestClassifier(labelCol="label", numTrees=1, bootstrap=False, maxDepth=4, seed=1).fit(data)
    folder = forests.shared_folder(spark) + "/one_tree"
    model.write().overwrite().save(folder)
    tree = forests._tree(spark.read.parquet(f"{folder}/data").select("nodeData.*").collect())
    rows = model.transform(data).select("x", "z", "k_ix", "prediction").collect()
    assert tree.categories
    assert (tree.classes(np.array([r[:3] for r in rows])) == [r.prediction for r in rows]).all()


@pytest.mark.parametrize("bucket_rows", [100, 10_000])
def test_noise_has_no_importance(planted, forest, bucket_rows):
    found = {(r.variabel, r.klasse): r for r in forests.oob_importance(forest, planted, "label", bucket_rows).collect()}
    assert len(found) == 9
    for k in (0, 1, None):
        noise, real = found["z", k], found["x", k]
        assert real.fall > 0.05 and real.fall > 4 * real.standardfeil
        assert abs(noise.fall) < max(0.02, 3 * noise.standardfeil)
        assert real.skalert == pytest.approx(real.fall / real.standardfeil)


def test_rows_without_label_and_few_rows(spark):
    rows = [(i, [None, 0, 1][i % 3], float(i % 3), 1.0) for i in range(30)]
    frame = spark.createDataFrame(rows, "id long, label int, x double, c double")
    few = forests.fit_forest(frame, "label", ["x", "c"], trees=3, mtry=2, depth=3)
    assert few.drawn.groupBy("tree", "label").count().select("count").distinct().collect() == [(7,)]
    votes = forests.oob_votes(few, frame, "label").where("label IS NULL")
    assert votes.where(F.col("votes_0") + F.col("votes_1") == 3).count() == 10
    assert forests.draws(frame.limit(0), "label", 3).count() == 0


def test_dependence_is_that_of_rows_with_the_value_set(planted, forest):
    X = np.array([[r.x, r.z, r.k_ix] for r in planted.select("x", "z", "k_ix").collect()])
    found = dependence.dependence(forest, planted, points=7).collect()
    assert Counter(r.variabel for r in found) == {"x": 7, "z": 7, "k_ix": 3}
    assert {r.niva for r in found} == {"a", "b", "c", None}
    for r in found:
        fixed = X.copy()
        fixed[:, forest.features.index(r.variabel)] = r.x
        assert r.andel == pytest.approx(np.mean([t.classes(fixed) for t in forest.trees]), abs=1e-12)


def test_leaves_hold_every_row_once(planted, forest):
    reach = dependence.leaf_reach(forest, planted).where(F.col("f") == dependence.STAYS)
    assert {(r.tree, r.n) for r in reach.groupBy("tree").agg(F.sum("n").alias("n")).collect()} == {(t, 900) for t in range(TREES)}


def test_dependence_of_repeated_rows_own_grid_and_no_rows(planted, forest):
    grid = {"x": [-100.0, 0.0, 100.0]}
    once = dependence.dependence(forest, planted, grid).collect()
    assert [(r.variabel, r.x) for r in once] == [("x", -100.0), ("x", 0.0), ("x", 100.0)]
    assert once[0].andel < once[2].andel
    assert dependence.dependence(forest, planted.union(planted), grid).collect() == once
    assert dependence.dependence(forest, planted.limit(0), grid).collect() == []
    assert dependence.dependence(forest, planted.limit(0)).count() == 0
