"""Models, evaluation, components and topics by their properties."""

import math
import re

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from themeloom.operators import evaluation, factors, models, text, topics

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def planted(spark):
    """Label depends on x1 and a little on x2; x3 is noise."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    p = 1 / (1 + np.exp(-(2.5 * x[:, 0] - 1.0 * x[:, 1])))
    y = (rng.random(1500) < p).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(1500)]
    return spark.createDataFrame(rows, "id int, label int, x1 double, x2 double, x3 double").persist()


@pytest.mark.parametrize(
    "kind,params",
    [
        ("logit", {}),
        ("rf", {"trees": 20, "mtry": 2, "depth": 5}),
        ("svm", {"cost": 10, "max_iter": 30}),
        ("ridge", {"points": 3, "folds": 3}),
        ("lasso", {"points": 3, "folds": 3}),
    ],
)
def test_classifiers_beat_chance(planted, kind, params):
    train, test = models.train_test_split(planted)
    model = models.fit_classifier(kind, train, "label", FEATURES, **params)
    assert evaluation.auc(models.score(model, test, "label")).first().auc > 0.8


def test_split_is_disjoint_and_stable(planted):
    train, test = models.train_test_split(planted)
    again, _ = models.train_test_split(planted.repartition(13))
    ids = {r.id for r in train.collect()}
    assert ids == {r.id for r in again.collect()}
    assert ids.isdisjoint({r.id for r in test.collect()}) and 0.75 < len(ids) / 1500 < 0.85


def test_largest_penalty_zeroes_all(planted):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    path = models.lambda_path(planted, "label", FEATURES, 1.0, 5)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(planted)
    fit = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=path[0] * 1.01).fit(data)
    assert np.allclose(fit.coefficients.toArray(), 0, atol=1e-6)
    part = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=path[0] * 0.3).fit(data)
    assert part.coefficients[0] != 0 and abs(part.coefficients[2]) < 1e-9


def test_explained_outcome(spark, planted):
    outcome = F.when(F.col("id") % 100 == 0, None).when(F.col("label") == 1, "Innvilget").otherwise("Avslatt")
    form = F.element_at(F.array(F.lit("AS"), F.lit("ENK"), F.lit("SA")), (F.col("id") % 3 + 1).cast("int"))
    data = planted.withColumns({"utfall": outcome, "org_form": form})
    table, scored = models.explain_outcome(data, "utfall", "Innvilget", FEATURES, ["org_form"])
    found = {r.ledd: r for r in table.collect()}
    assert len({r.aic for r in found.values()}) == 1 and found["x1"].aic > 0
    assert set(found) == {"x1", "x2", "x3", "(konstant)"}
    assert found["x1"].koeffisient > 0 > found["x2"].koeffisient and found["x1"].stjerner == "***"
    assert scored.count() == 1500 and scored.where("sannsynlighet is null").count() == 15
    # The score equations hold: residuals are orthogonal to each term.
    known = scored.where("sannsynlighet is not null")
    residual = F.col("label") - F.col("sannsynlighet")
    assert all(abs(v) < 1e-3 for v in known.agg(F.sum(residual), *[F.sum(residual * F.col(x)) for x in FEATURES]).first())


def test_first_level_is_reference(spark):
    df = spark.createDataFrame([(1.0, "a"), (0.0, "b"), (1.0, "c"), (0.0, "b")], "y double, g string")
    matrix = models.design_matrix(df, "y", ["g"])
    assert models._feature_names(matrix, "features") == ["g_c", "g_b"]


def test_importance_and_dependence(planted):
    train, test = models.train_test_split(planted)
    model = models.fit_classifier("rf", train, "label", FEATURES, trees=20, mtry=2, depth=5)
    gini = {r.variabel: r.viktighet for r in models.rf_importance(model, FEATURES, train).collect()}
    drop = {r.variabel: r.fall for r in models.permutation_importance(model, test, "label", FEATURES).collect()}
    assert max(gini, key=gini.get) == max(drop, key=drop.get) == "x1"
    assert abs(drop["x3"]) < 0.05 and abs(sum(gini.values()) - 1) < 1e-9
    grid = models.quantile_grid(test, "x1", 5)
    curve = [r.y for r in models.partial_dependence(model, test, "x1", grid, FEATURES).collect()]
    assert len(curve) == 5 and curve[-1] > curve[0]


def test_permutation_moves_every_value_once(planted):
    small = models.permutation_importance
    train, _ = models.train_test_split(planted)
    model = models.fit_classifier("rf", train, "label", FEATURES, trees=5, mtry=2, depth=4)
    one = {r.variabel for r in small(model, planted, "label", FEATURES, bucket_rows=100).collect()}
    assert one == set(FEATURES)


def test_crossfit_scores_every_row_once(planted):
    out = models.crossfit_predict("logit", planted, "label", FEATURES, folds=3)
    assert out.count() == out.select("id").distinct().count() == 1500


def test_weights_balance_the_classes(planted):
    weighted = models.with_class_weight(planted, "label")
    sums = [r[1] for r in weighted.groupBy("label").agg(F.sum("vekt")).collect()]
    assert abs(sums[0] - sums[1]) < 1e-3


def test_impute(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, 3.0, "a"), (3, None, None), (4, 8.0, "b")], "id int, x double, g string")
    filled = models.impute_median_mode(df, ["x"], ["g"]).where("id = 3").first()
    assert (filled.x, filled.g) == (3.0, "b")


def test_auc_and_roc(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 40))) for _ in range(800)]
    df = spark.createDataFrame([(a, b + 5 * a) for a, b in rows], "label int, score double")
    ours = evaluation.auc(df).first().auc
    vectors = df.select("label", array_to_vector(F.array(-F.col("score"), "score")).alias("rawPrediction"))
    assert abs(ours - BinaryClassificationEvaluator(labelCol="label").evaluate(vectors)) < 1e-9
    flipped = evaluation.auc(df.withColumn("score", -F.col("score"))).first().auc
    assert abs(ours + flipped - 1) < 1e-8
    points = evaluation.roc_points(df).orderBy("terskel").toPandas()
    assert points.tpr.iloc[0] == points.fpr.iloc[0] == 1.0 and points.tpr.is_monotonic_decreasing


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1), (0, 1), (None, 1)], "p int, r int")
    cells = evaluation.confusion(df, "p", "r")
    assert cells.agg(F.sum("n")).first()[0] == 6
    stats = evaluation.confusion_stats(cells, "p", "r").first()
    assert (stats.tp, stats.fp, stats.fn, stats.tn) == (2, 1, 1, 2)
    assert stats.accuracy == round(4 / 6, 6) and stats.kappa == round(1 / 3, 6)


def test_exact_interval():
    low, high = evaluation.accuracy_interval(81, 263)
    assert abs(low - 0.2527367) < 1e-6 and abs(high - 0.3676219) < 1e-6
    assert evaluation.accuracy_interval(0, 10)[0] == 0 and evaluation.accuracy_interval(10, 10)[1] == 1


def test_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 2))
    data = np.c_[base[:, 0], base[:, 0] + 0.2 * base[:, 1], base[:, 1], rng.normal(size=400)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id int, a double, b double, c double, d double")
    result = factors.pca(df, cols)
    assert np.allclose(result.matrix.T @ result.matrix, np.eye(4), atol=1e-8)
    sd = [r.standardavvik for r in result.variance.collect()]
    assert abs(sum(s * s for s in sd) - 4) < 1e-8
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(data.T)))[::-1]
    assert np.allclose(np.square(sd), values, atol=1e-8)
    scores = result.scores.toPandas()
    assert np.allclose(scores[["PC1", "PC2", "PC3", "PC4"]].std(ddof=1), sd, atol=1e-6)
    rotated, rotation = factors.varimax(result.matrix[:, :2].copy())
    assert np.allclose(rotation.T @ rotation, np.eye(2), atol=1e-10)
    assert np.allclose(result.matrix[:, :2] @ rotation, rotated)

    def spread(m):
        h = m / np.sqrt((m**2).sum(axis=1))[:, None]
        return (h**2).var(axis=0).sum()

    assert spread(rotated) >= spread(result.matrix[:, :2]) - 1e-12


def test_topics_are_found(spark):
    groups = [["sol", "vind", "strøm", "panel"], ["fisk", "hav", "båt", "tang"]]
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice(groups[i % 2], size=30))) for i in range(120)]
    df = spark.createDataFrame(docs, "id int, text string")
    words = sorted(w for g in groups for w in g)
    vectors = text.doc_vectors(text.split_words(df, "id", "text"), words)
    model = topics.fit_topics(vectors, 2, max_iter=30, optimizer="em")
    beta = topics.model_beta(model, words)
    leading = topics.top_words(beta, 4)
    found = {frozenset(r.words) for r in leading.groupBy("topic").agg(F.collect_set("word").alias("words")).collect()}
    assert found == {frozenset(g) for g in groups}
    theta = topics.model_theta(model, vectors)
    assert all(abs(r[1] - 1) < 1e-9 for r in theta.groupBy("id").agg(F.sum("p")).collect())
    labels = topics.label_topics(beta, 4).collect()
    assert {frozenset(r.sannsynlighet.split()) for r in labels} == found


def test_coherence_of_words_that_never_meet(spark):
    dtm = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, word string, n long")
    leading = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "topic string, word string, rank long")
    value = topics.semantic_coherence(dtm, leading).first().coherence
    assert abs(value - math.log(0.01 / 1.01)) < 1e-6


def test_stage_is_written_and_read(spark, tmp_path):
    from themeloom.sources import cut_lineage, read_registry, save_stage

    reg = spark.createDataFrame(
        [("1", "x", "1990", "10.1", "3", "AS", "03", "0301", 5.0, y) for y in ("2013", "2014")],
        "org_nr string, navn string, fnr_dat string, nace1_sn07 string, syss string, org_form string, fylke string, kommune string, oms double, aar string",
    )
    save_stage(reg, str(tmp_path / "reg"), partition_by=["aar"])
    one = read_registry(spark, str(tmp_path / "reg"), years=["2014"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and re.search(r"PartitionFilters: \[[^\]]*aar", plan)
    fixed = cut_lineage(spark.range(10).withColumn("r", F.rand()))
    assert fixed.collect() == fixed.collect()


def test_applications_from_csv(spark, tmp_path):
    from themeloom.sources import APPLICATION_SCHEMA, read_applications

    row = [1, "S1", "9", "M", "2014/3", None, 'to\nlinjer, "sitat"', None, "b", None, None, "c", *[None] * 7, 10.0, None]
    (spark.createDataFrame([row], APPLICATION_SCHEMA).write.options(header=True, quote='"', escape='"').csv(str(tmp_path / "c")))
    got = read_applications(spark, str(tmp_path / "c"), "csv", multi_line=True).first()
    assert got.id == "S1" and got.Budsjettkommentar == 'to\nlinjer, "sitat"' and got.omsoktbelop == 10.0


def test_rows_with_nan_keep_their_place(spark):
    data = [(i, "ja" if i % 3 else "nei", float("nan") if i % 10 == 0 else float(i % 7), None if i % 11 == 0 else "s") for i in range(400)]
    df = spark.createDataFrame(data, "id int, utfall string, x double, form string")
    _, scored = models.explain_outcome(df.drop("form"), "utfall", "ja", ["x"], [])
    assert scored.count() == 400 and scored.where("sannsynlighet IS NULL").count() == 40
    filled = models.impute_median_mode(df, ["x"], ["form"])
    assert filled.where("x IS NULL OR isnan(x) OR form IS NULL").count() == 0
    assert filled.where("id = 10").first().x == 3.0


def test_topics_are_matched_by_name(spark):
    theta = spark.createDataFrame([(1, "B", 1.0)], "id int, topic string, p double")
    beta = spark.createDataFrame([("A", "x", 0.5), ("A", "y", 0.5), ("B", "y", 1.0)], "topic string, word string, p double")
    dtm = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id int, word string, n int")
    assert [(r.word, r.q) for r in topics.cell_rates(dtm, theta, beta).orderBy("word").collect()] == [("x", 0.0), ("y", 1.0)]


def test_words_of_a_single_document_get_weight(spark):
    texts = spark.createDataFrame([(i, f"w{i} common") for i in range(60)], "id int, text string")
    words = sorted({f"w{i}" for i in range(60)} | {"common"})
    vectors = text.doc_vectors(text.split_words(texts, "id", "text"), words).cache()
    beta = topics.model_beta(topics.fit_topics(vectors, 2, max_iter=5), words)
    least = beta.groupBy("word").agg(F.max("p").alias("p")).where("word <> 'common'").agg(F.min("p")).first()[0]
    assert least > 0.001


def test_dependence_takes_any_number_of_levels(spark):
    df = spark.createDataFrame([(i, i % 2, f"c{i % 80:02d}") for i in range(800)], "id int, label int, c string")
    data = models.index_categories(df, ["c"]).cache()
    model = models.fit_classifier("rf", data, "label", ["c_ix"], trees=3, mtry=1, depth=3)
    levels = data.select(F.col("c_ix").alias("x")).distinct()
    assert models.partial_dependence(model, data, "c_ix", levels, ["c_ix"]).count() == 80


@pytest.fixture
def rows_with_words(spark, monkeypatch):
    """Twenty-five features in one vector, in the place of the table of themes and words."""
    from pyspark.ml.linalg import Vectors

    from themeloom.plans import modelling

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 25))
    rows = [(i, int(v[0] + 0.5 * rng.normal() > 0), Vectors.dense(v)) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, ["id", "label", "x"]).withColumn("label", F.col("label").cast("double"))
    monkeypatch.setattr(modelling.c, "training_table", lambda *_: table)
    return table


def test_logit_scores_training_and_test_rows(spark, rows_with_words):
    from themeloom.plans import QUERIES

    found = {r.id: r for r in QUERIES["clf_logit"](spark, "").collect()}
    train, test = ({r.id for r in part.collect()} for part in models.train_test_split(rows_with_words))
    assert len(train) + len(test) == len(found) == 300
    assert {i for i, r in found.items() if r["del"] == "trening"} == train
    assert {i for i, r in found.items() if r["del"] == "test"} == test
    assert all(0 <= r.score <= 1 for r in found.values())


def test_forest_of_a_theme_is_whole(spark, rows_with_words, monkeypatch):
    from themeloom.plans import QUERIES

    fit, fitted = models.fit_classifier, []
    monkeypatch.setattr(models, "fit_classifier", lambda *a, **b: fitted.append(fit(*a, **b)) or fitted[-1])
    assert QUERIES["clf_rf"](spark, "").count() == models.train_test_split(rows_with_words)[1].count()
    forest = fitted[0].stages[-1]
    assert forest.getNumTrees == 200 and forest.getOrDefault("maxDepth") >= 10
