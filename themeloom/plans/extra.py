"""Readers end to end, models with more controls, and the rest of the evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from themeloom.operators import evaluation, models, text, themes, topics
from themeloom.plans import catalog as c
from themeloom.plans import modelling
from themeloom.plans.catalog import query
from themeloom.sources import cut_lineage, lookups, read_applications, read_loadings, read_registry, save_stage
from themeloom.sources.scan import shared_folder


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(
    "stage_applications",
    """SELECT CAST(id AS VARCHAR) AS id, type AS ApplicationTypeName, utfall AS Utfall, saknummer AS Saknummer,
         CAST(omsoktbelop AS DOUBLE) AS omsoktbelop, CAST(innvilgetbelop AS DOUBLE) AS innvilgetbelop FROM apps""",
    ("apps",),
)
def stage_applications(spark, sf):
    """Applications in the layout of the export, stored and read back."""
    raw = c.applications(spark, sf).select(
        F.col("id").alias("...1"),
        F.col("id").cast("string").alias("SiebelID"),
        F.col("org_nr").alias("Organisasjonsnummer"),
        F.col("type").alias("ApplicationTypeName"),
        F.col("saknummer").alias("Saknummer"),
        F.col("utfall").alias("Utfall"),
        F.col("omsoktbelop").cast("double").alias("omsoktbelop"),
        F.col("innvilgetbelop").cast("double").alias("innvilgetbelop"),
    )
    path = _folder(spark)
    save_stage(raw, path)
    kept = ["id", "ApplicationTypeName", "Utfall", "Saknummer", "omsoktbelop", "innvilgetbelop"]
    return read_applications(spark, path).select(kept)


@query("stage_loadings", "SELECT CAST(id AS VARCHAR) AS id, tema, CAST(ladning AS DOUBLE) AS ladning FROM loadings", ("loadings",))
def stage_loadings(spark, sf):
    """Loadings stored in the long layout and read back."""
    long = c.loadings(spark, sf).select(F.col("id").cast("string").alias("id"), "tema", F.col("ladning").cast("double").alias("ladning"))
    path = _folder(spark)
    save_stage(long, path)
    return read_loadings(spark, path)


@query("stage_registry", "SELECT org_nr, navn, syss, org_form, aar FROM registry_raw WHERE aar IN ('1996', '1997')", ("registry_raw",))
def stage_registry(spark, sf):
    """The registry stored by year; two years read only their folders."""
    path = _folder(spark)
    save_stage(c.registry_raw(spark, sf), path, ["aar"])
    return read_registry(spark, path, ["1996", "1997"]).select("org_nr", "navn", "syss", "org_form", "aar")


# ---- models with the sector, and of the second theme set ----

SECTOR_CONTROLS = [*modelling.CONTROLS, "nace2"]


def _expected(scored, flags):
    known = scored.where(F.col("sannsynlighet").isNotNull())
    about = F.explode(F.filter(F.array(*[F.when(F.col(t) == 1, F.lit(t)) for t in flags]), lambda t: t.isNotNull()))
    rows = known.select("sannsynlighet", about.alias("tema"))
    return rows.groupBy("tema").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sannsynlighet"), 1).alias("forventet"))


def _expected_sql(source: str, flags) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{t}' AS tema, count(*) AS n, CAST(count(*) FILTER (utfall = 'Innvilget') AS DOUBLE) AS forventet
            FROM ({source}) WHERE {t} = 1) WHERE n > 0"""
        for t in flags
    )


KNOWN_SECTOR = f"SELECT * FROM analysis WHERE {' AND '.join(f'{x} IS NOT NULL' for x in ['utfall', *SECTOR_CONTROLS, *c.MERGED])}"


@query("logit_expected_sector", _expected_sql(KNOWN_SECTOR, c.MERGED), ("analysis",))
def logit_expected_sector(spark, sf):
    """The logit with legal form, county and sector as controls: probabilities add up to the grants of a theme."""
    data = cut_lineage(c.analysis(spark, sf).select("id", "utfall", *c.MERGED, *SECTOR_CONTROLS))
    return _expected(models.explain_outcome(data, "utfall", "Innvilget", c.MERGED, SECTOR_CONTROLS)[1], c.MERGED)


INDUSTRY = [t for t in lookups.INDUSTRY_FOUR.values() if t not in {x for g in lookups.INDUSTRY_FOUR_MERGED.values() for x in g}] + list(
    lookups.INDUSTRY_FOUR_MERGED
)


def _industry(spark, sf):
    wide = themes.merge_columns(c.wide_loadings(spark, sf, c.INDUSTRY_FOUR), lookups.INDUSTRY_FOUR_MERGED)
    from themeloom.operators import cleaning

    flags = cleaning.dichotomise_wide(wide, INDUSTRY).select("id", *INDUSTRY)
    return flags.join(c.outcomes(spark, sf), "id", "left")


def _industry_sql() -> str:
    member = {m: g for g, ms in lookups.INDUSTRY_FOUR_MERGED.items() for m in ms}
    code = {theme: topic for topic, theme in c.INDUSTRY_FOUR.items()}
    value = lambda t: f"max(ladning) FILTER (tema = '{code[t]}')"
    columns = []
    for t in INDUSTRY:
        parts = [m for m, g in member.items() if g == t] or [t]
        total = " + ".join(value(m) for m in parts)
        columns.append(f"{total} AS {t}")
    flags = ", ".join(f"CASE WHEN {t} * count({t}) OVER () >= sum({t}) OVER () THEN 1 ELSE 0 END AS {t}" for t in INDUSTRY)
    return f"SELECT f.*, utfall FROM (SELECT id, {flags} FROM (SELECT id, {', '.join(columns)} FROM loadings GROUP BY id)) f JOIN outcomes o ON o.id = f.id WHERE utfall IS NOT NULL"


@query("logit_expected_industry", _expected_sql(_industry_sql(), INDUSTRY), ("loadings", "outcomes"))
def logit_expected_industry(spark, sf):
    """The second set of themes: probabilities of the logit add up to the grants of a theme."""
    scored = models.explain_outcome(cut_lineage(_industry(spark, sf)), "utfall", "Innvilget", INDUSTRY, [])[1]
    return _expected(scored, INDUSTRY)


@query("industry_forest_total", "SELECT 1.0::DOUBLE AS sum")
def industry_forest_total(spark, sf):
    """A forest of the outcome on the second set: importances add up to one."""
    label = F.when(F.col("utfall") == "Innvilget", 1).otherwise(0)
    data = cut_lineage(_industry(spark, sf).where(F.col("utfall").isNotNull()).withColumn("label", label))
    weighted = models.with_class_weight(data, "label")
    model = models.fit_classifier("rf", weighted, "label", INDUSTRY, weight="vekt", trees=20, mtry=3, depth=5)
    return models.rf_importance(model, INDUSTRY, data).agg(F.round(F.sum("viktighet"), 9).alias("sum"))


@query(
    "boxplot_predicted",
    " UNION ALL ".join(
        f"SELECT '{t}' AS tema, CAST({t} AS INTEGER) AS flag, count(*) AS n, true AS ordnet FROM ({modelling.KNOWN}) GROUP BY {t}" for t in c.MERGED
    ),
    ("analysis",),
)
def boxplot_predicted(spark, sf):
    """Box of the predicted probability by theme and flag: its numbers are in order and between 0 and 1."""
    from themeloom.operators import distributions, reshape

    known = modelling._explained(spark, sf)[1].where(F.col("sannsynlighet").isNotNull())
    long = cut_lineage(reshape.to_long(known, ["id", "sannsynlighet"], c.MERGED, "tema", "flag"))
    boxes = distributions.boxplot_stats(long, ["tema", "flag"], "sannsynlighet")
    ordered = (F.col("nedre") >= 0) & (F.col("nedre") <= F.col("q1") + 1e-9) & (F.col("q1") <= F.col("median")) & (F.col("median") <= F.col("q3")) & (F.col("ovre") <= 1)
    return long.groupBy("tema", "flag").agg(F.count(F.lit(1)).alias("n")).join(boxes, ["tema", "flag"]).select("tema", "flag", "n", ordered.alias("ordnet"))


# ---- evaluation and topics ----


@query(
    "accuracy_interval",
    """SELECT round(avg(CASE WHEN (score > 50) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS treffsikkerhet, true AS innenfor
       FROM scores WHERE score IS NOT NULL""",
    ("scores",),
)
def accuracy_interval(spark, sf):
    """Accuracy with its exact interval; the interval holds the accuracy and is narrower than with half the rows."""
    cells = {(r.klasse, r.label): r.n for r in modelling.confusion_matrix(spark, sf).collect()}
    hits, n = cells.get((1, 1), 0) + cells.get((0, 0), 0), sum(cells.values())
    low, high = evaluation.accuracy_interval(hits, n)
    wide = evaluation.accuracy_interval(hits // 2, n // 2)
    inside = low <= hits / n <= high and high - low < wide[1] - wide[0]
    return spark.createDataFrame([(round(hits / n, 6), bool(inside))], "treffsikkerhet double, innenfor boolean")


def _bound_sql(first: str, last: str, rises: str) -> str:
    """Bisection for the share at which a tail of the binomial distribution, from first to last, holds 2.5 %."""
    tail = f"list_sum(list_transform(range({first}, {last}), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((s.lo + s.hi) / 2) + (n - k) * ln(1 - (s.lo + s.hi) / 2))))"
    zeros = "list_transform(range(50), lambda i: {'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE})"
    step = f"CASE WHEN {tail} {rises} 0.025 THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END"
    return f"round(list_reduce(list_prepend({{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}}, {zeros}), lambda s, x: {step}).lo, 6)"


@query(
    "accuracy_bounds",
    f"""SELECT round(hits / n, 6) AS treffsikkerhet, {_bound_sql("hits", "n + 1", "<")} AS nedre, {_bound_sql("0", "hits + 1", ">")} AS ovre
        FROM (SELECT CAST(count(*) FILTER ((score > 50) = (label = 1)) AS BIGINT) AS hits, count(*) AS n FROM scores WHERE score IS NOT NULL)""",
    ("scores",),
)
def accuracy_bounds(spark, sf):
    """Accuracy with the bounds of its exact interval."""
    cells = {(r.klasse, r.label): r.n for r in modelling.confusion_matrix(spark, sf).collect()}
    hits, n = cells.get((1, 1), 0) + cells.get((0, 0), 0), sum(cells.values())
    low, high = evaluation.accuracy_interval(hits, n)
    return spark.createDataFrame([(round(hits / n, 6), round(low, 6), round(high, 6))], "treffsikkerhet double, nedre double, ovre double")


@query(
    "prevalence_words",
    """SELECT t.topic, t.andel, w.ord FROM (SELECT topic, round(avg(p), 6) AS andel FROM theta GROUP BY topic) t
       JOIN (SELECT topic, string_agg(word, ' ' ORDER BY p DESC, word) AS ord
             FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p DESC, word) AS k FROM beta) WHERE k <= 3 GROUP BY topic) w
         ON w.topic = t.topic""",
    ("theta", "beta"),
)
def prevalence_words(spark, sf):
    """Mean share of each topic beside its three leading words."""
    leading = topics.label_topics(c.given_beta(spark, sf), 3).select("topic", F.col("sannsynlighet").alias("ord"))
    means = c.given_theta(spark, sf).groupBy("topic").agg(F.round(F.avg("p"), 6).alias("andel"))
    return means.join(leading, "topic")


@query("stopword_counts")
def stopword_counts(spark, sf):
    """Words of the texts without those of the stop-word table of three languages."""
    return text.counted_words(c.texts(spark, sf), "id", "text", stopwords=lookups.stopwords(spark), drop_numbers=True)
