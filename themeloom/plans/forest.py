"""Forests on balanced draws: the outcome on the firm's data and on both sets of themes, judged by unseen rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.operators import dependence, evaluation, forests, models
from themeloom.plans import catalog as c
from themeloom.plans import extra, modelling
from themeloom.plans.catalog import query
from themeloom.sources import cut_lineage

TREES = 24
SHARE = "CAST(0.632 AS DOUBLE)"

#: Rows of known outcome with their label, in both engines.
KNOWN = "SELECT id, CASE WHEN utfall = 'Innvilget' THEN 1 ELSE 0 END AS label FROM analysis WHERE utfall IS NOT NULL"
INDUSTRY_KNOWN = f"SELECT id, CASE WHEN utfall = 'Innvilget' THEN 1 ELSE 0 END AS label FROM ({extra._industry_sql()})"


def _drawn_sql(known: str) -> str:
    return f"""SELECT tree, id, label FROM (
        SELECT *, row_number() OVER (PARTITION BY tree, label ORDER BY number, id) AS place
        FROM (SELECT *, ('0x' || substr(md5('{models.SEED}|' || tree || '|' || id), 1, 8))::BIGINT AS number
              FROM ({known}) CROSS JOIN (SELECT unnest(range({TREES})) AS tree)))
      WHERE place <= ceil({SHARE} * (SELECT min(n) FROM (SELECT count(*) AS n FROM ({known}) GROUP BY label)))"""


def _outcome(spark, sf):
    """Known outcomes with imputed firm attributes and indexed categories, stored."""
    data = c.analysis(spark, sf).select("id", "utfall", *c.MERGED, "syss", "alder", *modelling.FIRM)
    label = F.when(F.col("utfall") == "Innvilget", 1).otherwise(0)
    known = cut_lineage(data.where(F.col("utfall").isNotNull()).withColumn("label", label))
    return models.index_categories(models.impute_median_mode(known, ["syss", "alder"], modelling.FIRM), modelling.FIRM)


def _outcome_forest(spark, sf):
    data = _outcome(spark, sf)
    return forests.fit_forest(data, "label", modelling.OUTCOME_FEATURES, trees=TREES, mtry=4, depth=8), data


def _industry_forest(spark, sf):
    label = F.when(F.col("utfall") == "Innvilget", 1).otherwise(0)
    data = cut_lineage(extra._industry(spark, sf).where(F.col("utfall").isNotNull()).withColumn("label", label))
    return forests.fit_forest(data, "label", extra.INDUSTRY, trees=TREES, mtry=3, depth=6), data


@query(
    "forest_draws",
    f"SELECT CAST(tree AS INTEGER) AS tree, label, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, max(id) AS id_max FROM ({_drawn_sql(KNOWN)}) GROUP BY tree, label",
    ("analysis",),
)
def forest_draws(spark, sf):
    """How many rows of each class every tree of the outcome forest draws, and which."""
    known = c.analysis(spark, sf).where(F.col("utfall").isNotNull())
    known = known.select("id", F.when(F.col("utfall") == "Innvilget", 1).otherwise(0).alias("label"))
    drawn = forests.draws(known, "label", TREES)
    return drawn.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"), F.max("id").alias("id_max"))


def _votes_sql(known: str) -> str:
    return f"""SELECT k.id, k.label, {TREES} - count(d.tree) AS stemmer
      FROM ({known}) k LEFT JOIN ({_drawn_sql(known)}) d ON d.id = k.id GROUP BY k.id, k.label"""


def _cells_sql(known: str) -> str:
    return f"SELECT label, count(*) FILTER (stemmer > 0) AS n, count(*) FILTER (stemmer = 0) AS uten FROM ({_votes_sql(known)}) GROUP BY label"


def _votes(forest, data):
    return forests.oob_votes(forest, data, "label").select("id", "label", (F.col("votes_0") + F.col("votes_1")).alias("stemmer"))


def _cells(forest, data):
    """Rows of each class in the confusion table of the votes, and rows without a vote."""
    votes = forests.oob_votes(forest, data, "label")
    cells = evaluation.confusion(votes, "klasse", "label")
    left_out = votes.groupBy("label").agg(F.count_if(F.col("klasse").isNull()).alias("uten"))
    return cells.groupBy("label").agg(F.sum("n").alias("n")).join(left_out, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n"), "uten")


@query("oob_votes", _votes_sql(KNOWN), ("analysis",))
def oob_votes(spark, sf):
    """How many trees of the outcome forest vote on each row: those that did not draw it."""
    return _votes(*_outcome_forest(spark, sf))


@query("oob_confusion")
def oob_confusion(spark, sf):
    """Confusion of the outcome with the votes of unseen trees."""
    votes = forests.oob_votes(*_outcome_forest(spark, sf), "label")
    return evaluation.confusion_stats(evaluation.confusion(votes, "klasse", "label"), "klasse", "label")


@query("oob_confusion_cells", _cells_sql(KNOWN), ("analysis",))
def oob_confusion_cells(spark, sf):
    return _cells(*_outcome_forest(spark, sf))


@query("oob_importance")
def oob_importance(spark, sf):
    """Fall in accuracy on unseen rows for each variable, for each class and for both."""
    return forests.oob_importance(*_outcome_forest(spark, sf), "label")


@query("industry_oob_confusion")
def industry_oob_confusion(spark, sf):
    """Confusion of the outcome on the second set of themes."""
    votes = forests.oob_votes(*_industry_forest(spark, sf), "label")
    return evaluation.confusion_stats(evaluation.confusion(votes, "klasse", "label"), "klasse", "label")


@query("industry_oob_cells", _cells_sql(INDUSTRY_KNOWN), ("loadings", "outcomes"))
def industry_oob_cells(spark, sf):
    return _cells(*_industry_forest(spark, sf))


@query("industry_oob_importance")
def industry_oob_importance(spark, sf):
    return forests.oob_importance(*_industry_forest(spark, sf), "label")


# ---- dependence on every variable ----


@query("forest_leaf_rows", f"SELECT tree, count(*) AS n FROM ({KNOWN}), (SELECT unnest(range({TREES})) AS tree) GROUP BY tree", ("analysis",))
def forest_leaf_rows(spark, sf):
    """The leaves of each tree hold every known application once."""
    reach = dependence.leaf_reach(*_outcome_forest(spark, sf))
    return reach.where(F.col("f") == dependence.STAYS).groupBy("tree").agg(F.sum("n").alias("n"))


@query("outcome_dependence")
def outcome_dependence(spark, sf):
    """Share of votes for a grant along all themes and attributes of the firm, from one scan."""
    curves = dependence.dependence(*_outcome_forest(spark, sf))
    return curves.withColumns({"x": F.round("x", 6), "andel": F.round("andel", 6)})


@query("industry_dependence")
def industry_dependence(spark, sf):
    """The same along the second set of themes."""
    curves = dependence.dependence(*_industry_forest(spark, sf))
    return curves.withColumns({"x": F.round("x", 6), "andel": F.round("andel", 6)})


DECILES = [i / 10 for i in range(11)]
NUMBERS = [(t, t) for t in c.MERGED] + [(x, f"coalesce(CAST({x} AS DOUBLE), (SELECT quantile_cont(CAST({x} AS DOUBLE), 0.5) FROM analysis WHERE utfall IS NOT NULL))") for x in ("syss", "alder")]


@query(
    "outcome_dependence_grid",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS variabel, round(x, 6) AS x FROM (SELECT unnest(quantile_cont(CAST({value} AS DOUBLE), {DECILES})) AS x FROM analysis WHERE utfall IS NOT NULL)"
        for name, value in NUMBERS
    ),
    ("analysis",),
)
def outcome_dependence_grid(spark, sf):
    """The curves have a point at every different decile of a number."""
    curves = outcome_dependence(spark, sf)
    return curves.where(F.col("niva").isNull()).select("variabel", "x")
