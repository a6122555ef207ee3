"""Models that explain an outcome or predict a theme, on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import RFormula, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from themeloom.functions import digest_number, if_else
from themeloom.operators.distributions import quantiles_by
from themeloom.operators.penalty_path import PathModel, fit_path

SEED = 23319
ROWS_PER_PARTITION = 20_000
PATH_ROWS = 1_000  # a row of a penalty path meets all folds and penalties at once


def train_test_split(df: DataFrame, id: str = "id", percent: int = 80, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Split by the id alone, so a row stays on its side however the data are partitioned."""
    train = digest_number(id, seed=seed, modulus=100) < percent
    return df.where(train), df.where(~train)


def design_matrix(df: DataFrame, label: str, terms: Sequence[str], out: str = "features") -> DataFrame:
    """Dummy-coded features, the first level as reference; incomplete rows are left out."""
    whole = df.where(is_complete(df, [label, *terms]))
    return _formula(whole, label, terms, out).transform(whole)


def _formula(df: DataFrame, label: str, terms: Sequence[str], out: str):
    formula = RFormula(
        formula=f"{label} ~ {' + '.join(terms)}",
        featuresCol=out,
        labelCol="_label",
        stringIndexerOrderType="alphabetDesc",
        handleInvalid="error",
    )
    return formula.fit(df)


def _feature_names(df: DataFrame, features: str) -> list[str]:
    attributes = df.schema[features].metadata["ml_attr"]["attrs"]
    listed = sorted((a["idx"], a["name"]) for group in attributes.values() for a in group)
    return [name for _, name in listed]


def explain_outcome(
    df: DataFrame, outcome: str, positive: str, terms: Sequence[str], controls: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Logit of the positive outcome: coefficient table of the terms, and all rows with their probability.

    Control coefficients are fitted but not listed; each row of the table has the AIC of the fit. Incomplete
    rows keep a NULL probability.
    """
    used = [*terms, *controls]
    data = df.withColumn("response", if_else(F.col(outcome) == positive, 1.0, 0.0))
    whole = is_complete(data, ["response", *used])
    complete, missing = sized(data.where(whole)), data.where(~whole)
    formula = _formula(complete, "response", used, "_features")
    matrix = formula.transform(complete)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_features", labelCol="response", maxIter=50
    ).fit(matrix)
    names = _feature_names(matrix, "_features")
    values = [*model.coefficients.toArray(), model.intercept]
    # Terms that depend on each other have coefficients but no standard errors.
    if _has_errors(model):
        errors, ps = model.summary.coefficientStandardErrors, model.summary.pValues
    else:
        errors = ps = [float("nan")] * len(values)
    aic = float(model.summary.aic)
    rows = [
        (name, float(b), float(se), float(b / se) if se else None, float(p), _stars(p), aic)
        for name, b, se, p in zip([*names, "(konstant)"], values, errors, ps)
        if not any(name.startswith(f"{c}_") or name == c for c in controls)
    ]
    table = df.sparkSession.createDataFrame(
        rows, "ledd string, koeffisient double, standardfeil double, z double, p double, stjerner string, aic double"
    )
    probability = F.col("prediction").alias("sannsynlighet")
    scored = model.transform(matrix).select(*df.columns, probability)
    rest = missing.select(*df.columns, F.lit(None).cast("double").alias("sannsynlighet"))
    return table, scored.unionByName(rest)


def is_complete(df: DataFrame, cols: Sequence[str]) -> Column:
    """True or false, never NULL: no column is missing; NaN counts as missing."""
    return ~reduce(lambda a, b: a | b, [_is_missing(df, c) for c in cols])


def _is_missing(df: DataFrame, c: str) -> Column:
    floating = isinstance(df.schema[c].dataType, (DoubleType, FloatType))
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def _has_errors(model) -> bool:
    """Whether the fit could solve the normal equations, which the standard errors come from."""
    try:
        return bool(model.summary.coefficientStandardErrors)
    except UnsupportedOperationException:
        return False


def _stars(p: float) -> str:
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""


def sized(df: DataFrame, rows: int = ROWS_PER_PARTITION, most: int | None = None) -> DataFrame:
    """Partitions of about `rows` rows, at most `most`, for the many short passes of a fit; never more than there are now."""
    partitions = df.count() // rows + 1
    return df.coalesce(partitions if most is None else min(partitions, most))


def _pipeline(df: DataFrame, features: Sequence[str], stage) -> Pipeline:
    """Features side by side in one vector; a single vector is taken as it is."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, VectorUDT):
        return Pipeline(stages=[stage.setFeaturesCol(features[0])])
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), stage])


def fit_classifier(
    kind: str, train: DataFrame, label: str, features: Sequence[str], **params
) -> PipelineModel | PathModel:
    """Classifier of a 0/1 label.

    kind: logit, rf (trees, mtry, weight), svm (cost), ridge or lasso (folds, points, id, tol, gain, max_scans). The features are
    numbers, or one vector column. Pass a cached table: it is counted first and read once per iteration.
    """
    if kind in ("ridge", "lasso"):
        # Every task sends sums of all folds and penalties: one for each core, however many rows there are.
        cores = train.sparkSession.sparkContext.defaultParallelism
        return _cross_validated(kind, sized(train, PATH_ROWS, cores), label, features, **params)
    train = sized(train)
    if kind == "logit":
        stage = LogisticRegression(labelCol=label, regParam=0.0, maxIter=params.get("max_iter", 100))
        return _pipeline(train, features, stage).fit(train)
    if kind == "rf":
        stage = RandomForestClassifier(
            labelCol=label,
            numTrees=params.get("trees", 200),
            featureSubsetStrategy=str(params.get("mtry", 8)),
            maxDepth=params.get("depth", 10),
            maxBins=max(params.get("max_bins", 64), *(_levels(train, f) for f in features)),
            seed=params.get("seed", SEED),
        )
        if params.get("weight"):
            stage = stage.setWeightCol(params["weight"])
        return _pipeline(train, features, stage).fit(train)
    if kind == "svm":
        cost = params.get("cost", 10)
        stage = LinearSVC(labelCol=label, regParam=1.0 / (cost * train.count()), maxIter=params.get("max_iter", 100))
        return _pipeline(train, features, stage).fit(train)
    raise ValueError(kind)


def _levels(df: DataFrame, feature: str) -> int:
    """Levels of an indexed category, from the column's metadata; 0 for numbers."""
    return len(df.schema[feature].metadata.get("ml_attr", {}).get("vals", []))


def lambda_path(df: DataFrame, label: str, features: Sequence[str], alpha: float, points: int) -> list[float]:
    """Falling penalties, from the one that puts all coefficients at zero down to a ten-thousandth of it."""
    y = F.col(label).cast("double")
    vectors = [c for c in features if isinstance(df.schema[c].dataType, VectorUDT)]
    numbers = [c for c in features if c not in vectors]
    strength = [F.abs(F.try_divide(F.covar_pop(F.col(c).cast("double"), y), F.stddev_pop(c))) for c in numbers]
    highest = df.agg(F.greatest(*strength, F.lit(0.0), F.lit(0.0)).alias("top")).first().top
    top = max([highest, *[_block_strength(df, y, c) for c in vectors]]) / max(alpha, 0.001)
    return [top * 10 ** (-4 * i / (points - 1)) for i in range(points)]


def _block_strength(df: DataFrame, y: Column, block: str) -> float:
    """The largest |covariance with the label| / deviation in a block; four arrays of its width reach the driver."""
    parts = df.select(F.col(block).alias("x"), y.alias("y")).agg(
        Summarizer.metrics("sum", "variance", "count").summary(F.col("x")).alias("all"),
        Summarizer.metrics("sum").summary(F.col("x"), F.col("y")).alias("marked"),
        F.avg("y").alias("share"),
    ).first()
    n = parts["all"]["count"]
    cov = parts["marked"]["sum"].toArray() / n - parts["share"] * parts["all"]["sum"].toArray() / n
    deviation = np.sqrt(parts["all"]["variance"].toArray() * (n - 1) / n)
    return float(np.abs(np.divide(cov, deviation, out=np.zeros_like(cov), where=deviation > 0)).max(initial=0.0))


def _cross_validated(
    kind: str,
    train: DataFrame,
    label: str,
    features: Sequence[str],
    folds: int = 5,
    points: int = 20,
    id: str = "id",
    tol: float = 1e-4,
    gain: float = 1e-5,
    max_scans: int = 60,
) -> PathModel:
    penalties = lambda_path(train, label, features, 0.0 if kind == "ridge" else 1.0, points)
    return fit_path(kind, train, label, features, penalties, folds, id, SEED + 1, tol, gain, max_scans)


def cv_curve(model: PathModel, spark: SparkSession) -> DataFrame:
    """Misclassification per penalty, mean and standard deviation over the folds."""
    return spark.createDataFrame(model.curve(), "lambda double, feil double, standardavvik double")


def score(model: PipelineModel | PathModel, df: DataFrame, label: str, id: str = "id") -> DataFrame:
    """(id, label, score): probability of class 1, or the decision value where there is none."""
    scored = model.transform(df)
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(
        id, F.col(label).cast("int").alias("label"), vector_to_array(column)[1].alias("score")
    )


def class_weights(df: DataFrame, label: str, target: str | Mapping = "min") -> DataFrame:
    """Weight per class that makes the classes count as the target sizes; 'min' is the smallest class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if target == "min":
        wanted = counts.agg(F.min("n")).scalar()
    else:
        wanted = reduce(lambda c, kv: F.when(F.col(label) == kv[0], kv[1]).otherwise(c), target.items(), F.lit(None))
    return counts.withColumn("vekt", F.round(wanted / F.col("n"), 9))


def with_class_weight(df: DataFrame, label: str, out: str = "vekt") -> DataFrame:
    """Attach the balancing weight; labels have two values."""
    from themeloom.operators.joins import attach

    return attach(df, class_weights(df, label).select(label, F.col("vekt").alias(out)), [label], "left", bounded=True)


def impute_median_mode(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Missing numbers (NULL or NaN) become the column's median, missing categories its most frequent value.

    One row per column comes to the driver. Equally frequent values: the first in order.
    """
    fill: dict[str, object] = {}
    if numeric:
        numbers = df.select(*[_number(c).alias(c) for c in numeric])
        long = numbers.unpivot([], list(numeric), "kolonne", "verdi")
        fill |= {r.kolonne: r.m for r in quantiles_by(long, ["kolonne"], "verdi", {"m": 0.5}).collect()}
    if categorical:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in categorical])
        long = texts.unpivot([], list(categorical), "kolonne", "verdi")
        counts = long.dropna().groupBy("kolonne", "verdi").agg(F.count(F.lit(1)).alias("n"))
        modes = counts.groupBy("kolonne").agg(F.min_by("verdi", F.struct(-F.col("n"), F.col("verdi"))).alias("m"))
        fill |= {r.kolonne: r.m for r in modes.collect()}
    filled = {}
    for c in [*numeric, *categorical]:
        base = _number(c) if c in numeric else F.col(c)
        filled[c] = F.coalesce(base, F.lit(fill[c])) if c in fill else base
    return df.withColumns(filled)


def _number(c: str) -> Column:
    """The column as double, NaN as NULL."""
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


def index_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add `<col>_ix`, the alphabetical index of each category, for tree models."""
    indexer = StringIndexer(
        inputCols=list(cols),
        outputCols=[f"{c}_ix" for c in cols],
        stringOrderType="alphabetAsc",
        handleInvalid="error",
    )
    return indexer.fit(df).transform(df)


def crossfit_predict(
    kind: str, df: DataFrame, label: str, features: Sequence[str], folds: int = 5, id: str = "id", **params
) -> DataFrame:
    """Every row scored by a model that has not seen it: (id, label, score)."""
    fold = digest_number(id, seed=SEED + 2, modulus=folds)
    parts = []
    for i in range(folds):
        model = fit_classifier(kind, df.where(fold != i), label, features, **params)
        parts.append(score(model, df.where(fold == i), label, id))
    return reduce(DataFrame.unionByName, parts)


def rf_importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Mean decrease in impurity per feature, summing to 1."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "variabel string, viktighet double")


def permutation_importance(
    model: PipelineModel, df: DataFrame, label: str, features: Sequence[str], id: str = "id", bucket_rows: int = 100_000
) -> DataFrame:
    """Drop in accuracy when a feature takes the value of another row.

    Rows are put in hash order within hash buckets of about bucket_rows rows and every value moves one
    row on, the last to the first. All features are moved in one window pass and all variants scored in
    one job.
    """
    buckets = df.count() // bucket_rows + 1
    order = digest_number(id, seed=SEED + 3, modulus=1 << 31)
    window = Window.partitionBy("_bucket").orderBy("_order", id)
    base = df.select(id, label, *features).withColumns({"_order": order, "_bucket": F.pmod(order, F.lit(buckets))})
    whole = Window.partitionBy("_bucket").orderBy("_order", id).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    moved = base.select(
        label,
        *features,
        *[F.coalesce(F.lead(f).over(window), F.first(f).over(whole)).alias(f"_moved_{f}") for f in features],
    )
    variants = moved.withColumn("variabel", F.explode(F.array(F.lit(""), *[F.lit(f) for f in features])))
    inputs = variants.select(
        label,
        "variabel",
        *[F.when(F.col("variabel") == f, F.col(f"_moved_{f}")).otherwise(F.col(f)).alias(f) for f in features],
    )
    hit = F.when(F.col("prediction") == F.col(label), 1.0).otherwise(0.0)
    accuracy = model.transform(inputs).groupBy("variabel").agg(F.avg(hit).alias("treffsikkerhet"))
    baseline = accuracy.where("variabel = ''").select("treffsikkerhet").scalar()
    return accuracy.where("variabel <> ''").select(
        "variabel", "treffsikkerhet", (baseline - F.col("treffsikkerhet")).alias("fall")
    )


def partial_dependence(
    model: PipelineModel, df: DataFrame, var: str, grid: Sequence | DataFrame, features: Sequence[str], cls: int = 1
) -> DataFrame:
    """Mean centred log probability of a class when one feature is set to each grid value in turn.

    The grid is a list, or a table whose column `x` holds the values, such as all levels of a category.
    """
    if isinstance(grid, DataFrame):
        values = F.explode(grid.agg(F.sort_array(F.collect_set(F.col("x").cast("double")))).scalar())
    else:
        values = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    rows = df.select(*[f for f in features if f != var]).withColumn(var, values)
    shares = F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-16))))
    logs = model.transform(rows).select(F.col(var).alias("x"), shares.alias("logs"))
    mean = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x) / F.size("logs")
    return logs.groupBy("x").agg(F.avg(F.col("logs")[cls] - mean).alias("y")).orderBy("x")


def quantile_grid(df: DataFrame, var: str, points: int = 11) -> list[float]:
    """Distinct quantiles of a feature, for a partial-dependence grid."""
    probs = {f"q{i}": i / (points - 1) for i in range(points)}
    row = quantiles_by(df.select(F.col(var).cast("double").alias(var)), [], var, probs).first()
    return sorted(set(row))


def threshold_class(score_col: Column | str, threshold: float) -> Column:
    """1 above the threshold, 0 otherwise, NULL without a score."""
    c = F.col(score_col) if isinstance(score_col, str) else score_col
    return (c > threshold).cast("int")
