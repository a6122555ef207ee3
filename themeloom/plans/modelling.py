"""Models of the outcome and of a theme, and their evaluation."""

from __future__ import annotations


from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F


from themeloom.operators import evaluation, models, text, word_features
from themeloom.plans import catalog as c
from themeloom.plans.catalog import query
from themeloom.sources import cut_lineage

SPLIT = f"('0x' || substr(md5('{models.SEED}|' || id), 1, 8))::BIGINT % 100 < 80"
CONTROLS = ["org_form", "fylke2"]
FOREST = {"trees": 50, "mtry": 8, "depth": 8}
THEME_FOREST = {"trees": 200, "mtry": 8, "depth": 10}


@query("train_test_split", f"SELECT id, CASE WHEN {SPLIT} THEN 'trening' ELSE 'test' END AS del FROM apps", ("apps",))
def train_test_split(spark, sf):
    train, test = models.train_test_split(c.application_parts(spark, sf).select("id"))
    return train.withColumn("del", F.lit("trening")).unionByName(test.withColumn("del", F.lit("test")))


@query(
    "word_cells",
    "SELECT id, celle, round(verdi, 9) + 0.0 AS verdi FROM word_cells",
    ("word_cells",),
)
def word_cells(spark, sf):
    """The words of each text as signed sums of tf-idf in 65,536 cells."""
    cells = word_features.word_cells(text.tf_idf(c.all_counts_with_totals(spark, sf), total="total"))
    return cells.select("id", F.col("cell").alias("celle"), (F.round("value", 9) + 0.0).alias("verdi"))


@query(
    "assemble_training",
    """SELECT m.*, coalesce(w.celler, 0) AS celler, round(coalesce(w.ordsum, 0), 6) + 0.0 AS ordsum, round(coalesce(w.ordvekt, 0), 6) AS ordvekt
       FROM model_table m LEFT JOIN (SELECT id, count(*) AS celler, sum(verdi) AS ordsum, sum(verdi * verdi) AS ordvekt
                                     FROM word_cells GROUP BY id) w USING (id)""",
    ("model_table", "word_cells"),
)
def assemble_training(spark, sf):
    """Themes and words of each application; of the words the number of cells, their sum and their sum of squares."""
    parts = F.unwrap_udt("x")
    words = F.slice(parts["values"], len(c.MODEL_THEMES) + 1, F.size(parts["values"]))
    total = lambda f: F.aggregate(words, F.lit(0.0), f)
    rows = c.training_table(spark, sf)
    return rows.select(
        *[name for name in rows.columns if name != "x"],
        (F.size(parts["indices"]) - len(c.MODEL_THEMES)).cast("long").alias("celler"),
        (F.round(total(lambda a, x: a + x), 6) + 0.0).alias("ordsum"),
        F.round(total(lambda a, x: a + x * x), 6).alias("ordvekt"),
    )


@query(
    "class_weights",
    """SELECT label, n, round(min(n) OVER () / n, 9) AS vekt
       FROM (SELECT label, count(*) AS n FROM scores GROUP BY label)""",
    ("scores",),
)
def class_weights(spark, sf):
    return models.class_weights(c.scores(spark, sf), "label")


@query(
    "impute_median_mode",
    """SELECT id, coalesce(alder, (SELECT quantile_cont(alder, 0.5) FROM analysis)) AS alder,
         coalesce(CAST(syss AS DOUBLE), (SELECT quantile_cont(CAST(syss AS DOUBLE), 0.5) FROM analysis)) AS syss,
         coalesce(org_form, (SELECT org_form FROM analysis WHERE org_form IS NOT NULL GROUP BY org_form
                             ORDER BY count(*) DESC, org_form LIMIT 1)) AS org_form,
         coalesce(fylke2, (SELECT fylke2 FROM analysis WHERE fylke2 IS NOT NULL GROUP BY fylke2
                           ORDER BY count(*) DESC, fylke2 LIMIT 1)) AS fylke2
       FROM analysis""",
    ("analysis",),
)
def impute_median_mode(spark, sf):
    data = cut_lineage(c.analysis(spark, sf).select("id", "alder", "syss", *CONTROLS))
    return models.impute_median_mode(data, ["alder", "syss"], CONTROLS)


def _with_label(spark, sf):
    data = c.analysis(spark, sf).select("id", "utfall", *c.MERGED, *CONTROLS)
    return data.withColumn("label", F.when(F.col("utfall") == "Innvilget", 1).when(F.col("utfall").isNotNull(), 0))


KNOWN = f"SELECT * FROM analysis WHERE {' AND '.join(f'{x} IS NOT NULL' for x in ['utfall', *CONTROLS, *c.MERGED])}"


@query(
    "design_matrix",
    f"""SELECT id, CASE WHEN utfall = 'Innvilget' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
          (SELECT {len(c.MERGED)} + count(DISTINCT org_form) + count(DISTINCT fylke2) - 2 FROM ({KNOWN})) AS kolonner,
          CAST({' + '.join(c.MERGED)} + CASE WHEN org_form > min(org_form) OVER () THEN 1 ELSE 0 END
            + CASE WHEN fylke2 > min(fylke2) OVER () THEN 1 ELSE 0 END AS DOUBLE) AS sum
        FROM ({KNOWN})""",
    ("analysis",),
)
def design_matrix(spark, sf):
    data = cut_lineage(_with_label(spark, sf).dropna())
    matrix = models.design_matrix(data, "label", [*c.MERGED, *CONTROLS])
    values = vector_to_array("features")
    return matrix.select(
        "id",
        F.col("_label").alias("label"),
        F.size(values).cast("long").alias("kolonner"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("sum"),
    )


FIRM = ["nace2", "org_form", "fylke2"]
OUTCOME_FEATURES = [*c.MERGED, "syss", "alder", *[f"{x}_ix" for x in FIRM]]


def _outcome_table(spark, sf):
    """Known outcomes with imputed firm attributes, indexed categories and balancing weights."""
    data = c.analysis(spark, sf).select("id", "utfall", *c.MERGED, "syss", "alder", *FIRM)
    label = F.when(F.col("utfall") == "Innvilget", 1).otherwise(0)
    known = cut_lineage(data.where(F.col("utfall").isNotNull()).withColumn("label", label))
    filled = models.impute_median_mode(known, ["syss", "alder"], FIRM)
    return models.with_class_weight(models.index_categories(filled, FIRM), "label")


@query("outcome_forest_importance")
def outcome_forest_importance(spark, sf):
    data = _outcome_table(spark, sf)
    model = models.fit_classifier("rf", data, "label", OUTCOME_FEATURES, weight="vekt", **FOREST)
    return models.rf_importance(model, OUTCOME_FEATURES, data)


@query("outcome_forest_confusion")
def outcome_forest_confusion(spark, sf):
    data = _outcome_table(spark, sf)
    scored = models.crossfit_predict("rf", data, "label", OUTCOME_FEATURES, folds=3, weight="vekt", **FOREST)
    classed = scored.withColumn("klasse", models.threshold_class("score", 0.5))
    return evaluation.confusion_stats(evaluation.confusion(classed, "klasse", "label"), "klasse", "label")


@query("outcome_partial_dependence")
def outcome_partial_dependence(spark, sf):
    """Dependence of the outcome on the legal form, one row per form."""
    data = _outcome_table(spark, sf)
    model = models.fit_classifier("rf", data, "label", OUTCOME_FEATURES, weight="vekt", **FOREST)
    levels = data.select(F.col("org_form_ix").alias("x"), "org_form").distinct()
    curve = models.partial_dependence(model, data, "org_form_ix", levels, OUTCOME_FEATURES)
    return curve.join(levels, "x").select("org_form", F.round("y", 6).alias("y"))


def _explained(spark, sf):
    # Several passes read the table, so it is written once.
    data = cut_lineage(c.analysis(spark, sf).select("id", "utfall", *c.MERGED, *CONTROLS))
    return models.explain_outcome(data, "utfall", "Innvilget", c.MERGED, CONTROLS)


@query("logit_fit")
def logit_fit(spark, sf):
    data = cut_lineage(c.analysis(spark, sf).select("id", "utfall", *c.MERGED))
    return models.explain_outcome(data, "utfall", "Innvilget", c.MERGED, [])[0]


@query("coef_table")
def coef_table(spark, sf):
    return _explained(spark, sf)[0]


@query("predict_logit")
def predict_logit(spark, sf):
    scored = _explained(spark, sf)[1]
    return scored.select("id", "utfall", F.round("sannsynlighet", 6).alias("sannsynlighet"))


def _split(spark, sf):
    train, test = models.train_test_split(cut_lineage(c.model_table(spark, sf)))
    return train.persist(), test


def _split_with_words(spark, sf, cells=word_features.CELLS):
    train, test = models.train_test_split(c.training_table(spark, sf, cells))
    return train.persist(), test


def _classifier(name: str, kind: str, **params) -> None:
    @query(name)
    def run(spark, sf):
        """Scores of the test rows from themes and words."""
        train, test = _split_with_words(spark, sf)
        model = models.fit_classifier(kind, train, "label", ["x"], **params)
        train.unpersist()
        return models.score(model, test, "label").withColumn("score", F.round("score", 6))


@query("clf_logit")
def clf_logit(spark, sf):
    """Scores of the rows that were learned from and of the test rows, from themes and words."""
    train, test = _split_with_words(spark, sf)
    model = models.fit_classifier("logit", train, "label", ["x"])
    train.unpersist()
    parts = [models.score(model, rows, "label").withColumn("del", F.lit(name)) for name, rows in (("trening", train), ("test", test))]
    return parts[0].unionByName(parts[1]).withColumn("score", F.round("score", 6))


_classifier("clf_svm", "svm", cost=10, max_iter=50)
_classifier("clf_ridge", "ridge", points=6, folds=5)
_classifier("clf_lasso", "lasso", points=6, folds=5)


@query("clf_rf")
def clf_rf(spark, sf):
    train, test = _split_with_words(spark, sf, word_features.FOREST_CELLS)
    weighted = models.with_class_weight(train, "label")
    model = models.fit_classifier("rf", weighted, "label", ["x"], weight="vekt", **THEME_FOREST)
    return models.score(model, test, "label").withColumn("score", F.round("score", 6))


@query("cv_curve")
def cv_curve(spark, sf):
    train, _ = _split(spark, sf)
    model = models.fit_classifier("ridge", train, "label", c.MODEL_THEMES, points=6, folds=5)
    train.unpersist()
    return models.cv_curve(model, spark)


@query("crossfit_predict")
def crossfit_predict(spark, sf):
    data = cut_lineage(c.model_table(spark, sf))
    out = models.crossfit_predict("rf", data, "label", c.MODEL_THEMES, folds=3, trees=20, mtry=8, depth=6)
    return out.withColumn("score", F.round("score", 6))


def _forest(spark, sf):
    train, test = _split(spark, sf)
    return models.fit_classifier("rf", train, "label", c.MODEL_THEMES, **FOREST), test


@query("rf_importance")
def rf_importance(spark, sf):
    model, test = _forest(spark, sf)
    return models.rf_importance(model, c.MODEL_THEMES, test)


@query("permutation_importance")
def permutation_importance(spark, sf):
    model, test = _forest(spark, sf)
    return models.permutation_importance(model, test, "label", c.MODEL_THEMES)


@query("partial_dependence")
def partial_dependence(spark, sf):
    model, test = _forest(spark, sf)
    grid = models.quantile_grid(test, "V1")
    return models.partial_dependence(model, test, "V1", grid, c.MODEL_THEMES)


# ---- evaluation ----


@query(
    "confusion_matrix",
    "SELECT klasse, label, count(*) AS n FROM (SELECT label, CAST(score > 50 AS INTEGER) AS klasse FROM scores) WHERE klasse IS NOT NULL GROUP BY ALL",
    ("scores",),
)
def confusion_matrix(spark, sf):
    classed = c.scores(spark, sf).withColumn("klasse", models.threshold_class("score", 50.0))
    return evaluation.confusion(classed, "klasse", "label")


@query(
    "confusion_stats",
    """SELECT tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(greatest(tp + fn, fp + tn) / n, 6) AS no_information_rate,
         round(((tp + tn) / n - chance) / (1 - chance), 6) AS kappa, round((abs(fp - fn) - 1) ** 2 / (fp + fn), 6) AS mcnemar,
         round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity,
         round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round((tp + fn) / n, 6) AS prevalence,
         round(tp / n, 6) AS detection_rate, round((tp + fp) / n, 6) AS detection_prevalence,
         round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy
       FROM (SELECT *, tp + fp + fn + tn AS n,
               ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS chance
             FROM (SELECT CAST(count(*) FILTER (score > 50 AND label = 1) AS DOUBLE) AS tp,
                     CAST(count(*) FILTER (score > 50 AND label = 0) AS DOUBLE) AS fp,
                     CAST(count(*) FILTER (score <= 50 AND label = 1) AS DOUBLE) AS fn,
                     CAST(count(*) FILTER (score <= 50 AND label = 0) AS DOUBLE) AS tn FROM scores))""",
    ("scores",),
)
def confusion_stats(spark, sf):
    return evaluation.confusion_stats(confusion_matrix(spark, sf), "klasse", "label")


RANKED = """SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores WHERE score IS NOT NULL GROUP BY score"""


@query(
    "roc_points",
    f"""SELECT score AS terskel,
          round(CAST(sum(pos) OVER w AS DOUBLE) / (SELECT sum(label) FROM scores WHERE score IS NOT NULL), 6) AS tpr,
          round(CAST(sum(neg) OVER w AS DOUBLE) / (SELECT count(*) - sum(label) FROM scores WHERE score IS NOT NULL), 6) AS fpr
        FROM ({RANKED}) WINDOW w AS (ORDER BY score DESC)""",
    ("scores",),
)
def roc_points(spark, sf):
    return evaluation.roc_points(c.scores(spark, sf))


@query(
    "auc",
    """SELECT round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * q), 9) AS auc
       FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r,
               CAST(sum(label) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () - sum(label) OVER () AS DOUBLE) AS q
             FROM scores WHERE score IS NOT NULL) GROUP BY p, q""",
    ("scores",),
)
def auc(spark, sf):
    return evaluation.auc(c.scores(spark, sf))


@query("model_comparison")
def model_comparison(spark, sf):
    train, test = _split(spark, sf)
    scored = {}
    for kind, params in (
        ("logit", {}),
        ("rf", FOREST),
        ("svm", {"cost": 10, "max_iter": 50}),
        ("ridge", {"points": 4, "folds": 3}),
        ("lasso", {"points": 4, "folds": 3}),
    ):
        scored[kind] = models.score(models.fit_classifier(kind, train, "label", c.MODEL_THEMES, **params), test, "label")
    result = evaluation.model_comparison(scored)
    train.unpersist()
    return result
