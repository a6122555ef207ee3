"""What must hold of fitted models whatever their digits, so that SQL can say it too."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.operators import factors, models, topics
from themeloom.plans import catalog as c
from themeloom.plans import modelling, texts
from themeloom.plans.catalog import query
from themeloom.sources import cut_lineage

KINDS = {
    "logit": {},
    "rf": {"trees": 20, "mtry": 8, "depth": 6},
    "svm": {"cost": 10, "max_iter": 30},
    "ridge": {"points": 3, "folds": 3},
    "lasso": {"points": 3, "folds": 3},
}
TEST = f"SELECT * FROM model_table WHERE NOT ({modelling.SPLIT})"
TRAIN = f"SELECT * FROM model_table WHERE {modelling.SPLIT}"


def _wide(spark, sf):
    return cut_lineage(c.wide_loadings(spark, sf, c.TOPIC_THEMES))


@query(
    "pca_rebuilt_correlation",
    """SELECT a.tema AS a, b.tema AS b, round(corr(CAST(a.ladning AS DOUBLE), CAST(b.ladning AS DOUBLE)), 6) AS r
       FROM themes a JOIN themes b ON a.id = b.id AND a.tema < b.tema GROUP BY a.tema, b.tema""",
    ("themes",),
)
def pca_rebuilt_correlation(spark, sf):
    """All components together give back the correlations."""
    found = factors.pca(_wide(spark, sf), c.THEMES)
    scaled = found.loadings.join(found.variance, "komponent")
    left = scaled.select("komponent", F.col("variabel").alias("a"), (F.col("ladning") * F.col("standardavvik") ** 2).alias("x"))
    right = found.loadings.select("komponent", F.col("variabel").alias("b"), F.col("ladning").alias("y"))
    pairs = left.join(right, "komponent").where("a < b")
    return pairs.groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("r"))


LENGTHS = """SELECT id, round(sqrt(sum(z * z)), 6) AS lengde
  FROM (SELECT id, (x - avg(x) OVER g) / stddev_samp(x) OVER g AS z
        FROM (SELECT id, tema, CAST(ladning AS DOUBLE) AS x FROM themes) WINDOW g AS (PARTITION BY tema)) GROUP BY id"""


def _lengths(scores, prefix):
    squares = sum(F.col(f"{prefix}{i + 1}") ** 2 for i in range(len(c.THEMES)))
    return scores.select("id", F.round(F.sqrt(squares), 6).alias("lengde"))


@query("pca_score_lengths", LENGTHS, ("themes",))
def pca_score_lengths(spark, sf):
    """Scores on all components are as long as the standardised rows."""
    return _lengths(factors.pca(_wide(spark, sf), c.THEMES).scores, "PC")


@query("pca_rotated_score_lengths", LENGTHS, ("themes",))
def pca_rotated_score_lengths(spark, sf):
    """Rotation keeps the lengths."""
    wide = _wide(spark, sf)
    return _lengths(factors.rotated_scores(wide, c.THEMES, factors.pca(wide, c.THEMES)), "RC")


@query("pca_rotated_loading_lengths", f"SELECT unnest([{c.sql_list(c.THEMES)}]) AS variabel, 1.0::DOUBLE AS lengde")
def pca_rotated_loading_lengths(spark, sf):
    wide = _wide(spark, sf)
    rotated = factors.rotated_loadings(wide, c.THEMES, factors.pca(wide, c.THEMES))
    return rotated.groupBy("variabel").agg(F.round(F.sqrt(F.sum(F.col("ladning") ** 2)), 6).alias("lengde"))


@query(
    "logit_expected",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS tema, count(*) AS n, CAST(count(*) FILTER (utfall = 'Innvilget') AS DOUBLE) AS forventet
            FROM ({modelling.KNOWN}) WHERE {t} = 1"""
        for t in c.MERGED
    ),
    ("analysis",),
)
def logit_expected(spark, sf):
    """The fitted probabilities of the applications about a theme add up to its grants."""
    known = modelling._explained(spark, sf)[1].where(F.col("sannsynlighet").isNotNull())
    flags = F.explode(F.filter(F.array(*[F.when(F.col(t) == 1, F.lit(t)) for t in c.MERGED]), lambda t: t.isNotNull()))
    rows = known.select("sannsynlighet", flags.alias("tema"))
    return rows.groupBy("tema").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sannsynlighet"), 2).alias("forventet"))


@query(
    "logit_scored_rows",
    f"""SELECT id, {' AND '.join(f'{x} IS NOT NULL' for x in ['utfall', *modelling.CONTROLS, *c.MERGED])} AS fullstendig
        FROM analysis""",
    ("analysis",),
)
def logit_scored_rows(spark, sf):
    """Every application is there; the complete ones have a probability between 0 and 1."""
    p = F.col("sannsynlighet")
    return modelling._explained(spark, sf)[1].select("id", F.coalesce(p.between(0, 1), F.lit(False)).alias("fullstendig"))


@query(
    "classifier_rows",
    f"""SELECT id, CAST(label AS INTEGER) AS label, {len(KINDS)} AS modeller, {len(KINDS)} AS med_verdi FROM ({TEST})""",
    ("model_table",),
)
def classifier_rows(spark, sf):
    """Each of the five classifiers scores every test row once."""
    train, test = modelling._split(spark, sf)
    scored = [models.score(models.fit_classifier(k, train, "label", c.MODEL_THEMES, **p), test, "label") for k, p in KINDS.items()]
    train.unpersist()
    rows = scored[0]
    for more in scored[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy("id", "label").agg(F.count(F.lit(1)).cast("int").alias("modeller"), F.count_if(~F.isnan("score")).cast("int").alias("med_verdi"))
    return counts


@query("crossfit_rows", "SELECT id, CAST(label AS INTEGER) AS label, 1 AS ganger FROM model_table", ("model_table",))
def crossfit_rows(spark, sf):
    """Every row is scored once."""
    rows = modelling.crossfit_predict(spark, sf)
    return rows.groupBy("id", "label").agg(F.count("score").cast("int").alias("ganger"))


@query("importance_totals", "SELECT unnest(['tema', 'utfall']) AS skog, 1.0::DOUBLE AS sum")
def importance_totals(spark, sf):
    """The importances of a forest add up to one."""
    total = lambda df, name: df.agg(F.round(F.sum("viktighet"), 9).alias("sum")).select(F.lit(name).alias("skog"), "sum")
    return total(modelling.rf_importance(spark, sf), "tema").union(total(modelling.outcome_forest_importance(spark, sf), "utfall"))


@query(
    "outcome_confusion_totals",
    """SELECT CAST(count(*) FILTER (utfall = 'Innvilget') AS DOUBLE) AS innvilget,
         CAST(count(*) FILTER (utfall <> 'Innvilget') AS DOUBLE) AS avslatt FROM analysis WHERE utfall IS NOT NULL""",
    ("analysis",),
)
def outcome_confusion_totals(spark, sf):
    """The cells of the confusion table add up to the classes."""
    cells = modelling.outcome_forest_confusion(spark, sf)
    return cells.select((F.col("tp") + F.col("fn")).cast("double").alias("innvilget"), (F.col("fp") + F.col("tn")).cast("double").alias("avslatt"))


@query("outcome_dependence_levels", "SELECT DISTINCT coalesce(org_form, (SELECT org_form FROM analysis WHERE utfall IS NOT NULL AND org_form IS NOT NULL GROUP BY org_form ORDER BY count(*) DESC, org_form LIMIT 1)) AS org_form FROM analysis WHERE utfall IS NOT NULL", ("analysis",))
def outcome_dependence_levels(spark, sf):
    """The curve has a point for every legal form."""
    return modelling.outcome_partial_dependence(spark, sf).select("org_form")


@query(
    "dependence_points",
    f"SELECT DISTINCT round(x, 6) AS x FROM (SELECT unnest(quantile_cont(V1, {[i / 10 for i in range(11)]})) AS x FROM ({TEST}))",
    ("model_table",),
)
def dependence_points(spark, sf):
    """The curve has a point for every quantile of the feature."""
    return modelling.partial_dependence(spark, sf).select(F.round("x", 6).alias("x"))


@query(
    "permutation_features",
    f"SELECT unnest([{c.sql_list(c.MODEL_THEMES)}]) AS variabel, true AS innenfor",
)
def permutation_features(spark, sf):
    """Every feature has an accuracy, and the falls are differences of accuracies."""
    rows = modelling.permutation_importance(spark, sf)
    return rows.select("variabel", (F.col("treffsikkerhet").between(0, 1) & F.col("fall").between(-1, 1)).alias("innenfor"))


@query(
    "cv_penalties",
    "SELECT round(max(s) / 0.001::DOUBLE * pow(10, -4 * i / 5), 6) AS lambda FROM (" + " UNION ALL ".join(
        f"SELECT abs(covar_pop({x}, CAST(label AS DOUBLE)) / stddev_pop({x})) AS s FROM ({TRAIN})" for x in c.MODEL_THEMES
    ) + "), (SELECT unnest(range(0, 6)) AS i) GROUP BY i",
    ("model_table",),
)
def cv_penalties(spark, sf):
    """The penalties fall from the one that puts all coefficients at zero."""
    return modelling.cv_curve(spark, sf).select(F.round("lambda", 6).alias("lambda"))


FOLD = f"('0x' || substr(md5('{models.SEED + 1}|' || id), 1, 8))::BIGINT % 3"
SCORES = " UNION ALL ".join(
    f"""SELECT sett, straff, '{x}' AS variabel, round(avg({x} * label), 4) + 0.0 AS snitt
        FROM (SELECT *, {FOLD} AS fold FROM ({TRAIN})), (SELECT unnest(range(0, 4)) AS sett), (SELECT unnest(range(0, 3)) AS straff)
        WHERE fold <> sett GROUP BY sett, straff"""
    for x in c.MODEL_THEMES
)


def _score_equations(kind):
    """The mean of feature times label in a training set, from the fitted probabilities.

    Where the optimality condition holds, the mean of feature times probability and the pull of the penalty (its
    subgradient nearest to the condition) give it for every feature, training set (3: all rows) and penalty.
    """

    def run(spark, sf):
        train, _ = modelling._split(spark, sf)
        model = models.fit_classifier(kind, train, "label", c.MODEL_THEMES, points=3, folds=3, tol=1e-9, gain=0.0, max_scans=400)
        train.unpersist()
        rows = [
            (group, place, name, float(value))
            for group, places in enumerate(model.expected)
            for place, values in enumerate(places)
            for name, value in zip(c.MODEL_THEMES, values, strict=True)
        ]
        table = spark.createDataFrame(rows, "sett long, straff long, variabel string, snitt double")
        return table.withColumn("snitt", F.round("snitt", 4) + 0.0)

    return run


query("ridge_score_equations", SCORES, ("model_table",))(_score_equations("ridge"))
query("lasso_score_equations", SCORES, ("model_table",))(_score_equations("lasso"))


@query("topic_fit_totals", "SELECT DISTINCT id, CAST(5 AS BIGINT) AS emner, 1.0::DOUBLE AS sum FROM trimmed", ("trimmed",))
def topic_fit_totals(spark, sf):
    """Every text with a word of the vocabulary has a share in each topic, and the shares add up to one."""
    model, vectors, _ = texts._fitted(spark, sf)
    shares = topics.model_theta(model, vectors)
    return shares.groupBy("id").agg(F.count_distinct("topic").alias("emner"), F.round(F.sum("p"), 6).alias("sum"))


@query("topic_fit_label_words", "SELECT unnest(['V1', 'V2', 'V3', 'V4', 'V5']) AS topic, 20 AS ord, 20 AS kjente")
def topic_fit_label_words(spark, sf):
    """Each label has the asked number of words, all of the vocabulary."""
    model, _, words = texts._fitted(spark, sf)
    labels = topics.label_topics(topics.model_beta(model, words), 20)
    known = F.array(*[F.lit(w) for w in words])
    listed = F.split("sannsynlighet", " ")
    return labels.select("topic", F.size(listed).alias("ord"), F.size(F.array_intersect(listed, known)).alias("kjente"))


@query(
    "topic_k_rows",
    """SELECT k, metric FROM (SELECT unnest([4, 8])::BIGINT AS k), (SELECT unnest(['lower_bound', 'residuals',
         'semantic_coherence', 'exclusivity', 'heldout_likelihood', 'iterations']) AS metric)""",
)
def topic_k_rows(spark, sf):
    """Every number of topics has every measure, and none is missing."""
    rows = texts.topic_k_metrics(spark, sf)
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select("k", "metric")
