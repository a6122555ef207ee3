"""Counts, shares, summaries, distributions and the theme network."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.operators import cleaning, crosstab, distributions, factors, network, reshape, themes
from themeloom.plans import catalog as c
from themeloom.plans.catalog import query
from themeloom.sources import cut_lineage, lookups

# ---- counts and shares ----

SHARE = """CAST(count(*) FILTER (flag = 0) AS BIGINT) AS uten, CAST(count(*) FILTER (flag = 1) AS BIGINT) AS med,
  round(count(*) FILTER (flag = 1) * 100.0::DOUBLE / nullif(count(flag), 0), 6) AS prosent"""


@query("count_by", "SELECT org_form, aar, count(*) AS n FROM registry GROUP BY ALL", ("registry",))
def count_by(spark, sf):
    return themes.count_by(c.full_registry(spark, sf), ["org_form", "aar"])


@query(
    "theme_mean",
    "SELECT tema, round(CAST(sum(ladning) AS DOUBLE) / count(*), 6) AS gjennomsnitt FROM themes GROUP BY tema",
    ("themes",),
)
def theme_mean(spark, sf):
    return themes.group_mean(c.theme_loadings(spark, sf), ["tema"], "ladning")


@query(
    "theme_median_mean",
    """SELECT tema, round(quantile_cont(CAST(ladning AS DOUBLE), 0.5), 9) AS median,
         round(CAST(sum(ladning) AS DOUBLE) / count(*), 9) AS gjennomsnitt FROM themes GROUP BY tema""",
    ("themes",),
)
def theme_median_mean(spark, sf):
    summary = distributions.summary_by(c.theme_loadings(spark, sf), ["tema"], "ladning")
    return summary.select("tema", "median", F.col("mean").alias("gjennomsnitt"))


SUMMARY = """count(ladning) AS n, round(min(CAST(ladning AS DOUBLE)), 9) AS min,
  round(quantile_cont(CAST(ladning AS DOUBLE), 0.25), 9) AS q1,
  round(quantile_cont(CAST(ladning AS DOUBLE), 0.5), 9) AS median,
  round(CAST(sum(ladning) AS DOUBLE) / count(ladning), 9) AS mean,
  round(quantile_cont(CAST(ladning AS DOUBLE), 0.75), 9) AS q3, round(max(CAST(ladning AS DOUBLE)), 9) AS max"""


@query("theme_summary", f"SELECT tema, {SUMMARY} FROM high GROUP BY tema", ("high",))
def theme_summary(spark, sf):
    return distributions.summary_by(themes.high_loading(c.theme_loadings(spark, sf)), ["tema"], "ladning")


@query(
    "five_number_summary",
    f"""SELECT 'Alle' AS utvalg, {SUMMARY} FROM themes
        UNION ALL SELECT 'Over_gjennomsnittet', {SUMMARY} FROM high""",
    ("themes", "high"),
)
def five_number_summary(spark, sf):
    everything = c.theme_loadings(spark, sf)
    frames = {"Alle": everything, "Over_gjennomsnittet": themes.high_loading(everything)}
    return distributions.stack_summaries(frames, "ladning")


@query("freq_table", "SELECT utfall, count(*) AS n FROM apps WHERE utfall IS NOT NULL GROUP BY utfall", ("apps",))
def freq_table(spark, sf):
    return themes.freq_table(c.outcomes(spark, sf), "utfall")


@query(
    "min_class_size",
    "SELECT min(n) AS minste FROM (SELECT count(*) AS n FROM apps WHERE utfall IS NOT NULL GROUP BY utfall)",
    ("apps",),
)
def min_class_size(spark, sf):
    return themes.min_class_size(c.outcomes(spark, sf), "utfall")


def _share_query(name: str, dim: str) -> None:
    @query(name, f"SELECT {dim}, {SHARE} FROM analysis_long GROUP BY {dim}", ("analysis_long",))
    def run(spark, sf):
        return crosstab.crosstab_share(c.analysis_long(spark, sf), [dim])


def _count_query(name: str, dim: str) -> None:
    @query(
        name,
        f"SELECT {dim}, tema, count(*) AS n FROM analysis_long WHERE flag = 1 AND {dim} IS NOT NULL GROUP BY ALL",
        ("analysis_long",),
    )
    def run(spark, sf):
        return crosstab.crosstab_count(c.analysis_long(spark, sf), [dim, "tema"])


for _name, _dim in (
    ("county", "fylke2"),
    ("sector", "nace2"),
    ("legal_form", "org_form"),
    ("age", "alder"),
    ("outcome", "utfall"),
):
    _share_query("crosstab_share" if _name == "county" else f"crosstab_share_{_name}", _dim)
    _count_query("crosstab_count" if _name == "county" else f"crosstab_count_{_name}", _dim)


@query(
    "crosstab_share_theme_county",
    f"SELECT fylke2, tema, {SHARE} FROM analysis_long GROUP BY fylke2, tema",
    ("analysis_long",),
)
def crosstab_share_theme_county(spark, sf):
    return crosstab.crosstab_share(c.analysis_long(spark, sf), ["fylke2", "tema"])


@query(
    "crosstab_share_documents",
    f"""SELECT org_form, {SHARE} FROM (SELECT id, org_form, max(flag) AS flag FROM analysis_long GROUP BY ALL)
        GROUP BY org_form""",
    ("analysis_long",),
)
def crosstab_share_documents(spark, sf):
    return crosstab.crosstab_share(c.analysis_long(spark, sf), ["org_form"], unit="documents")


@query(
    "crosstab_total",
    f"SELECT {SHARE} FROM analysis_long",
    ("analysis_long",),
)
def crosstab_total(spark, sf):
    return crosstab.crosstab_share(c.analysis_long(spark, sf), [])


@query(
    "any_theme_by_sector",
    f"""SELECT nace2, {SHARE} FROM (SELECT nace2, greatest({', '.join(c.MERGED)}) AS flag FROM analysis)
        WHERE nace2 IS NOT NULL GROUP BY nace2 HAVING count(flag) > 0""",
    ("analysis",),
)
def any_theme_by_sector(spark, sf):
    return crosstab.any_theme_by_dim(c.analysis(spark, sf), c.MERGED, "nace2")


@query(
    "outcome_by_theme",
    """SELECT tema AS kilde, CASE WHEN flag = 0 THEN 'Ingen' ELSE tema END AS tema, flag, utfall, count(*) AS n
       FROM analysis_long GROUP BY ALL""",
    ("analysis_long",),
)
def outcome_by_theme(spark, sf):
    return crosstab.outcome_by_theme(c.analysis_long(spark, sf), "utfall")


GRANTED = """CAST(count(*) FILTER (utfall = 'Innvilget') AS BIGINT) AS innvilget,
  CAST(count(*) FILTER (utfall <> 'Innvilget') AS BIGINT) AS avslatt,
  round(count(*) FILTER (utfall = 'Innvilget') * 100.0::DOUBLE / count(*), 6) AS prosent"""


@query(
    "grant_rate",
    f"SELECT tema, {GRANTED} FROM analysis_long WHERE flag = 1 AND utfall IS NOT NULL GROUP BY tema ORDER BY prosent DESC",
    ("analysis_long",),
)
def grant_rate(spark, sf):
    rates = crosstab.grant_rate(c.analysis_long(spark, sf), "utfall", "Innvilget")
    return rates.orderBy(F.desc("prosent"), "tema")


@query(
    "grant_rate_overall",
    f"SELECT {GRANTED} FROM analysis_long WHERE flag = 1 AND utfall IS NOT NULL",
    ("analysis_long",),
)
def grant_rate_overall(spark, sf):
    return crosstab.grant_rate(c.analysis_long(spark, sf), "utfall", "Innvilget", by=[])


MERGED_NAME = {m: name for name, group in lookups.INDUSTRY_FOUR_MERGED.items() for m in group}
MERGED_VALUES = ", ".join(f"('{code}', '{MERGED_NAME.get(t, t)}')" for code, t in c.INDUSTRY_FOUR.items())


@query(
    "industry_four_share",
    f"""SELECT tema, {SHARE} FROM (
          SELECT tema, CASE WHEN ladning * count(*) OVER (PARTITION BY tema) >= sum(ladning) OVER (PARTITION BY tema)
                         THEN 1 ELSE 0 END AS flag
          FROM (SELECT id, label AS tema, CAST(sum(ladning) * CAST(if(count(*) = 2, 0.5, 1.0) AS DECIMAL(2,1)) AS DECIMAL(19,7)) AS ladning
                FROM loadings JOIN (VALUES {MERGED_VALUES}) AS m(code, label) ON tema = code
                GROUP BY id, label)) GROUP BY tema""",
    ("loadings",),
)
def industry_four_share(spark, sf):
    chosen = c.loadings(spark, sf, list(c.INDUSTRY_FOUR))
    named = cleaning.recode(chosen, "tema", c.INDUSTRY_FOUR, "tema")
    merged = themes.merge_themes(named, lookups.INDUSTRY_FOUR_MERGED)
    return crosstab.crosstab_share(themes.dichotomise_mean(merged), ["tema"])


@query(
    "theme_share_of_granted",
    f"SELECT tema, {SHARE} FROM analysis_long WHERE utfall = 'Innvilget' GROUP BY tema",
    ("analysis_long",),
)
def theme_share_of_granted(spark, sf):
    return crosstab.theme_share_of_outcome(c.analysis_long(spark, sf), "utfall", "Innvilget")


@query(
    "outcome_split",
    """SELECT tema, CAST(uten AS BIGINT) AS uten, CAST(med AS BIGINT) AS med,
         round(med * 100.0::DOUBLE / sum(med) OVER (), 6) AS prosent_med,
         round(uten * 100.0::DOUBLE / sum(uten) OVER (), 6) AS prosent_uten
       FROM (SELECT tema, count(*) FILTER (flag = 0) AS uten, count(*) FILTER (flag = 1) AS med
             FROM analysis_long WHERE utfall = 'Innvilget' GROUP BY tema)""",
    ("analysis_long",),
)
def outcome_split(spark, sf):
    return crosstab.outcome_split(c.analysis_long(spark, sf), "utfall", "Innvilget")


def _total_share_query(name: str, dim: str, drop_null: bool) -> None:
    known = f"AND {dim} IS NOT NULL" if drop_null else ""

    @query(
        name,
        f"""SELECT {dim}, n, CAST(sum(n) OVER () AS BIGINT) AS sum, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS prosent
            FROM (SELECT {dim}, count(*) AS n FROM analysis_long WHERE flag = 1 {known} GROUP BY {dim})""",
        ("analysis_long",),
    )
    def run(spark, sf):
        return themes.share_of_total(c.analysis_long(spark, sf).where("flag = 1"), [dim], drop_null)


_total_share_query("share_of_total", "fylke2", False)
_total_share_query("share_of_total_sector", "nace2", False)
_total_share_query("share_of_total_outcome", "utfall", False)
_total_share_query("share_of_total_known_outcome", "utfall", True)

# ---- distributions and factors ----


@query(
    "kde_by_group",
    """SELECT g.tema, g.punkt, round(g.lo + g.punkt * (g.hi - g.lo) / 511, 6) AS x,
         round(sum(w * exp(-0.5 * pow(((g.lo + g.punkt * (g.hi - g.lo) / 511) - (g.lo + cell * g.step)) / g.bw, 2)))
               / (any_value(g.n) * any_value(g.bw) * sqrt(2 * pi())), 6) AS tetthet
       FROM (SELECT b.*, punkt, lo, hi, (hi - lo) / 511 AS step
             FROM (SELECT tema, n, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(n, -0.2) AS bw
                   FROM (SELECT tema, count(*) AS n, stddev_samp(x) AS sd,
                           (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34 AS iqr FROM data GROUP BY tema)) b
             CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM data)
             CROSS JOIN (SELECT unnest(range(512)) AS punkt)) g
       JOIN (SELECT tema, cell, sum(w) AS w FROM (
               SELECT tema, cell, 1 - (place - cell) AS w FROM places
               UNION ALL SELECT tema, cell + 1, place - cell FROM places) GROUP BY ALL) c ON g.tema = c.tema
       GROUP BY g.tema, g.punkt, g.lo, g.hi""",
    ("data", "places"),
)
def kde_by_group(spark, sf):
    return distributions.kde(c.theme_loadings(spark, sf), "tema", "ladning")


@query(
    "boxplot_stats",
    """SELECT tema, flag, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median, round(any_value(q3), 9) AS q3,
         round(min(x) FILTER (x >= q1 - (q3 - q1) * 1.5 AND x <= q3 + (q3 - q1) * 1.5), 9) AS nedre,
         round(max(x) FILTER (x >= q1 - (q3 - q1) * 1.5 AND x <= q3 + (q3 - q1) * 1.5), 9) AS ovre,
         count(*) FILTER (x < q1 - (q3 - q1) * 1.5 OR x > q3 + (q3 - q1) * 1.5) AS utliggere
       FROM (SELECT tema, flag, x, quantile_cont(x, 0.25) OVER g AS q1, quantile_cont(x, 0.5) OVER g AS median,
               quantile_cont(x, 0.75) OVER g AS q3
             FROM (SELECT a.tema, a.flag, CAST(l.ladning AS DOUBLE) AS x
                   FROM analysis_long a JOIN loadings l ON a.id = l.id AND l.tema = 'V1')
             WINDOW g AS (PARTITION BY tema, flag))
       GROUP BY tema, flag""",
    ("analysis_long", "loadings"),
)
def boxplot_stats(spark, sf):
    score = c.wide_loadings(spark, sf, {"V1": "ladning"})
    flags = reshape.to_long(c.theme_flags(spark, sf), ["id"], c.MERGED, "tema", "flag")
    return distributions.boxplot_stats(cut_lineage(flags.join(score, "id")), ["tema", "flag"], "ladning")


@query(
    "theme_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM wide"
        for i, a in enumerate(c.MERGED)
        for b in c.MERGED[i + 1 :]
    ),
    ("wide",),
)
def theme_correlation(spark, sf):
    return factors.correlation_long(c.merged_wide(spark, sf), c.MERGED)


def _wide_themes(spark, sf):
    # Several passes read the table.
    return cut_lineage(c.wide_loadings(spark, sf, c.TOPIC_THEMES))


@query("pca_loadings")
def pca_loadings(spark, sf):
    return factors.pca(_wide_themes(spark, sf), c.THEMES).loadings


@query("pca_variance")
def pca_variance(spark, sf):
    return factors.pca(_wide_themes(spark, sf), c.THEMES).variance


@query("pca_scores")
def pca_scores(spark, sf):
    return factors.pca(_wide_themes(spark, sf), c.THEMES).scores


@query("pca_rotated_loadings")
def pca_rotated_loadings(spark, sf):
    wide = _wide_themes(spark, sf)
    return factors.rotated_loadings(wide, c.THEMES, factors.pca(wide, c.THEMES, k=3))


@query("pca_rotated_scores")
def pca_rotated_scores(spark, sf):
    wide = _wide_themes(spark, sf)
    return factors.rotated_scores(wide, c.THEMES, factors.pca(wide, c.THEMES, k=3))


# ---- network ----


@query("repeat_firms", "SELECT org_nr, n FROM repeat_firms ORDER BY n DESC, org_nr", ("repeat_firms",))
def repeat_firms(spark, sf):
    return network.repeated(c.high_firm_theme(spark, sf), ["org_nr"])


@query("repeat_firm_themes", "SELECT org_nr, tema, n FROM repeat_pairs ORDER BY n DESC, org_nr, tema", ("repeat_pairs",))
def repeat_firm_themes(spark, sf):
    return network.repeated(c.high_firm_theme(spark, sf), ["org_nr", "tema"])


@query("multi_theme_firms", "SELECT DISTINCT org_nr, tema, n FROM multi_rows", ("multi_rows",))
def multi_theme_firms(spark, sf):
    return network.multi_theme_firms(c.high_firm_theme(spark, sf), "org_nr", "tema")


@query("theme_firm_count", "SELECT tema, count(*) AS n FROM multi_rows GROUP BY tema", ("multi_rows",))
def theme_firm_count(spark, sf):
    return network.theme_firm_count(c.high_firm_theme(spark, sf), "org_nr", "tema")


def _network(spark, sf):
    edges = network.multi_theme_firms(c.high_firm_theme(spark, sf), "org_nr", "tema")
    return network.project_bipartite(edges, "org_nr", "tema")


@query("theme_network", "SELECT * FROM network", ("network",))
def theme_network(spark, sf):
    return _network(spark, sf)


@query(
    "theme_degree",
    """SELECT tema, CAST(sum(weight) AS BIGINT) AS grad, count(*) AS naboer
       FROM (SELECT src AS tema, weight FROM network UNION ALL SELECT dst, weight FROM network) GROUP BY tema""",
    ("network",),
)
def theme_degree(spark, sf):
    return network.weighted_degree(_network(spark, sf))


@query(
    "simplify_edges",
    """SELECT least(a.p_brand, b.p_brand) AS src, greatest(a.p_brand, b.p_brand) AS dst, count(*) AS weight
       FROM lineitem x JOIN part a ON x.l_partkey = a.p_partkey JOIN supplier s ON x.l_suppkey = s.s_suppkey
       JOIN part b ON b.p_partkey = s.s_suppkey WHERE a.p_brand <> b.p_brand GROUP BY ALL""",
)
def simplify_edges(spark, sf):
    # Directed edges between brands, with loops and parallel edges in both directions.
    part = c.table(spark, sf, "part").select("p_partkey", "p_brand")
    lines = c.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight"))
    edges = lines.join(part.toDF("l_partkey", "src"), "l_partkey").join(part.toDF("l_suppkey", "dst"), "l_suppkey")
    supplier = c.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return network.simplify_edges(edges.join(supplier, "l_suppkey", "left_semi"))


@query(
    "bipartite_check",
    """SELECT count(*) AS felles, count(*) = 0 AS tomodus
       FROM (SELECT DISTINCT org_nr AS name FROM high_firms INTERSECT SELECT DISTINCT tema FROM high_firms)""",
    ("high_firms",),
)
def bipartite_check(spark, sf):
    return network.bipartite_check(c.high_firm_theme(spark, sf), "org_nr", "tema")
