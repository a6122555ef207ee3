"""Scans, column edits, filters, recoding, reshaping, joins and registry assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import (
    any_flag,
    blank_to_null,
    first_match,
    in_set,
    matches_any,
    percent,
    to_number,
)
from themeloom.operators import cleaning, joins, registry, reshape, themes
from themeloom.plans import catalog as c
from themeloom.plans.catalog import query
from themeloom.sources import lookups

# ---- scans ----


@query("scan_applications", "SELECT id, lang, type, utfall, omsoktbelop, innvilgetbelop, saknummer FROM apps", ("apps",))
def scan_applications(spark: SparkSession, sf: str) -> DataFrame:
    return c.applications(spark, sf).select(
        "id", "lang", "type", "utfall", "omsoktbelop", "innvilgetbelop", "saknummer"
    )


@query("scan_loadings", "SELECT id, tema, CAST(ladning AS DOUBLE) AS ladning FROM loadings", ("loadings",))
def scan_loadings(spark, sf):
    return c.loadings(spark, sf).withColumn("ladning", F.col("ladning").cast("double"))


@query(
    "scan_registry",
    "SELECT org_nr, navn, fnr_dat, nace1_sn07, syss, org_form, fylke, kommune, oms, aar FROM registry_raw WHERE aar IN ('1996', '1997')",
    ("registry_raw",),
)
def scan_registry(spark, sf):
    return c.registry_raw(spark, sf).where(F.col("aar").isin("1996", "1997"))


# ---- projections ----


@query("project_columns", "SELECT id, type, omsoktbelop FROM apps", ("apps",))
def project_columns(spark, sf):
    return c.application_parts(spark, sf).select("id", "type", "omsoktbelop")


@query("drop_columns", "SELECT doc_id, lang, source FROM documents")
def drop_columns(spark, sf):
    return c.table(spark, sf, "documents").drop("text", "n_chars")


@query("select_by_pattern", "SELECT id, field_1, field_2, field_3, field_4, field_5, field_6 FROM apps", ("apps",))
def select_by_pattern(spark, sf):
    return cleaning.select_by_prefix(c.application_parts(spark, sf), "field_", also=["id"])


@query("rename_columns", "SELECT c_custkey AS org_nr, c_name AS navn, c_mktsegment AS org_form FROM customer")
def rename_columns(spark, sf):
    customer = c.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return customer.withColumnsRenamed({"c_custkey": "org_nr", "c_name": "navn", "c_mktsegment": "org_form"})


@query(
    "map_columns",
    "SELECT id, "
    + ", ".join(f"coalesce(trim(field_{k}), '0') AS field_{k}" for k in range(1, 7))
    + " FROM apps",
    ("apps",),
)
def map_columns(spark, sf):
    parts = c.application_parts(spark, sf).select("id", *c.FIELDS)
    return cleaning.map_columns(parts, c.FIELDS, lambda x: F.coalesce(F.trim(x), F.lit("0")))


@query(
    "build_text",
    "SELECT id, "
    + " || ".join(f"coalesce(field_{k}, ' ')" for k in range(1, 7))
    + " AS text, CAST(length(text) AS BIGINT) AS n_chars FROM apps".replace("length(text)", "length(apps.text)"),
    ("apps",),
)
def build_text(spark, sf):
    parts = c.application_parts(spark, sf).select("id", *c.FIELDS, F.length("text").cast("long").alias("n_chars"))
    return cleaning.build_text(parts, c.FIELDS).select("id", "text", "n_chars")


@query("fill_zero", "SELECT id, coalesce(innvilgetbelop, 0) AS innvilgetbelop FROM apps", ("apps",))
def fill_zero(spark, sf):
    return cleaning.fill_zero(c.applications(spark, sf).select("id", "innvilgetbelop"), ["innvilgetbelop"])


# ---- filters ----


@query("filter_type", "SELECT id, saknummer FROM apps WHERE type = (SELECT min(source) FROM documents)", ("apps",))
def filter_type(spark, sf):
    first = c.table(spark, sf, "documents").agg(F.min("source").alias("s")).scalar()
    return c.application_parts(spark, sf).where(F.col("type") == first).select("id", "saknummer")


@query("filter_themes", "SELECT id, tema, CAST(ladning AS DOUBLE) AS ladning FROM themes", ("themes",))
def filter_themes(spark, sf):
    return c.theme_loadings(spark, sf).withColumn("ladning", F.col("ladning").cast("double"))


@query("high_loading", "SELECT id, tema, CAST(ladning AS DOUBLE) AS ladning FROM high", ("high",))
def high_loading(spark, sf):
    return themes.high_loading(c.theme_loadings(spark, sf)).withColumn("ladning", F.col("ladning").cast("double"))


@query(
    "high_loading_industry_four",
    "SELECT tema, count(*) AS n FROM (SELECT m.label AS tema, l.ladning FROM loadings l JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in c.INDUSTRY_FOUR.items())
    + ") AS m(code, label) ON l.tema = m.code QUALIFY ladning * count(*) OVER (PARTITION BY label) >= "
    "sum(ladning) OVER (PARTITION BY label)) GROUP BY tema",
    ("loadings",),
)
def high_loading_industry_four(spark, sf):
    chosen = c.loadings(spark, sf, list(c.INDUSTRY_FOUR))
    named = cleaning.recode(chosen, "tema", c.INDUSTRY_FOUR, "tema")
    return themes.count_by(themes.high_loading(named), ["tema"])


@query(
    "filter_regex_any",
    r"SELECT org_nr, aar, nace1_sn07 FROM registry_raw WHERE regexp_matches(nace1_sn07, '^(69|7[0-5])\.[0-9]+')",
    ("registry_raw",),
)
def filter_regex_any(spark, sf):
    codes = [rf"^{i}\.[0-9]+" for i in range(69, 76)]
    raw = c.registry_raw(spark, sf).select("org_nr", "aar", "nace1_sn07")
    return raw.where(matches_any("nace1_sn07", codes))


@query(
    "any_theme_flag",
    "SELECT id, greatest(" + ", ".join(c.MERGED) + ") AS flag FROM flags",
    ("flags",),
)
def any_theme_flag(spark, sf):
    return c.theme_flags(spark, sf).select("id", any_flag(c.MERGED).alias("flag"))


@query(
    "complete_cases",
    "SELECT id, utfall, org_nr, innvilgetbelop FROM apps WHERE utfall IS NOT NULL AND org_nr IS NOT NULL AND innvilgetbelop IS NOT NULL",
    ("apps",),
)
def complete_cases(spark, sf):
    return cleaning.complete_cases(c.applications(spark, sf).select("id", "utfall", "org_nr", "innvilgetbelop"))


# ---- recoding ----


@query(
    "recode_theme",
    """SELECT l.id, coalesce(d.label, m.label, l.tema) AS tema FROM loadings l
       LEFT JOIN theme_map m ON l.tema = m.code LEFT JOIN theme_labels d ON m.label = d.code""",
    ("loadings", "theme_map", "theme_labels"),
)
def recode_theme(spark, sf):
    named = cleaning.recode(c.loadings(spark, sf).select("id", "tema"), "tema", c.TOPIC_THEMES, "tema")
    return cleaning.recode(named, "tema", lookups.THEME_LABELS, "tema")


@query(
    "recode_lookup_null",
    "SELECT r.navn, r.aar, r.fylke, c.label AS fylke2 FROM registry_raw r LEFT JOIN counties c ON r.fylke = c.code",
    ("registry_raw", "counties"),
)
def recode_lookup_null(spark, sf):
    raw = c.registry_raw(spark, sf).select("navn", "aar", "fylke")
    return cleaning.recode(raw, "fylke", lookups.COUNTIES, "fylke2", default="null")


@query(
    "recode_lookup_passthrough",
    """SELECT navn, aar, CASE WHEN nace <> '00' THEN coalesce(label, nace) END AS nace2
       FROM (SELECT navn, aar, substr(nace1_sn07, 1, 2) AS nace FROM registry_raw)
       LEFT JOIN sectors ON CAST(nace AS INTEGER) BETWEEN first_code AND last_code""",
    ("registry_raw", "sectors"),
)
def recode_lookup_passthrough(spark, sf):
    raw = c.registry_raw(spark, sf).select("navn", "aar", first_match("nace1_sn07", "[0-9]{2}").alias("nace"))
    return cleaning.recode(raw, "nace", lookups.sectors(), "nace2", null_codes=["00"]).drop("nace")


@query(
    "binary_outcome",
    """SELECT o_orderkey, CASE WHEN status IS NULL THEN NULL WHEN status = 'F' THEN 'Innvilget' ELSE 'Avslatt' END AS utfall
       FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)""",
)
def binary_outcome(spark, sf):
    orders = c.table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("utfall"))
    renamed = orders.replace({"F": "Innvilget"}, subset=["utfall"])
    return cleaning.binary_outcome(renamed, "utfall", "Innvilget", "Avslatt", "utfall")


@query(
    "dichotomise_mean",
    """SELECT id, tema, CAST(CASE WHEN ladning * count(*) OVER (PARTITION BY tema) >= sum(ladning) OVER (PARTITION BY tema)
         THEN 1 ELSE 0 END AS INTEGER) AS flag FROM themes""",
    ("themes",),
)
def dichotomise_mean(spark, sf):
    return themes.dichotomise_mean(c.theme_loadings(spark, sf)).select("id", "tema", "flag")


@query("theme_flags_wide", "SELECT * FROM flags", ("flags",))
def theme_flags_wide(spark, sf):
    return c.theme_flags(spark, sf)


@query("fill_missing_label", "SELECT id, coalesce(org_nr, 'missing') AS org_nr FROM apps", ("apps",))
def fill_missing_label(spark, sf):
    return cleaning.fill_missing_label(c.application_parts(spark, sf).select("id", "org_nr"), "org_nr", "missing")


@query(
    "flag_by_membership",
    """SELECT id, tema, CASE WHEN tema IN ('vann', 'materialer', 'fornybar', 'deling') THEN 'olive' ELSE 'gray' END AS farge
       FROM themes""",
    ("themes",),
)
def flag_by_membership(spark, sf):
    bold = in_set("tema", ["vann", "materialer", "fornybar", "deling"])
    return c.theme_loadings(spark, sf).select("id", "tema", F.when(bold, "olive").otherwise("gray").alias("farge"))


@query(
    "ordered_levels",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'AUTOMOBILE' THEN 3 END::BIGINT
         AS org_form_ord,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN c_mktsegment END AS org_form
       FROM customer""",
)
def ordered_levels(spark, sf):
    customer = c.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("org_form"))
    return cleaning.level_order(customer, "org_form", ["MACHINERY", "BUILDING", "AUTOMOBILE"])


@query(
    "reorder_levels",
    """SELECT tema, median, dense_rank() OVER (ORDER BY median) AS ord
       FROM (SELECT tema, round(quantile_cont(CAST(ladning AS DOUBLE), 0.5), 9) AS median FROM loadings GROUP BY tema)""",
    ("loadings",),
)
def reorder_levels(spark, sf):
    return cleaning.reorder_levels(c.loadings(spark, sf), "tema", "ladning")


@query(
    "extract_code",
    r"""SELECT id, nullif(regexp_extract(saknummer, '[0-9]{1,4}'), '') AS aar,
          nullif(regexp_extract(field_1, '[0-9]{2}'), '') AS kode FROM apps""",
    ("apps",),
)
def extract_code(spark, sf):
    return c.application_parts(spark, sf).select(
        "id", first_match("saknummer", "[0-9]{1,4}").alias("aar"), first_match("field_1", "[0-9]{2}").alias("kode")
    )


@query(
    "safe_cast",
    """SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS t,
         CAST(user_id AS VARCHAR) AS bruker FROM events""",
)
def safe_cast(spark, sf):
    return c.table(spark, sf, "events").select(
        "event_id",
        to_number(first_match("props", "[0-9]+")).alias("k"),
        to_number("event_type").alias("t"),
        F.col("user_id").cast("string").alias("bruker"),
    )


@query(
    "merge_themes", "SELECT id, tema, CAST(ladning AS DOUBLE) AS ladning FROM merged", ("merged",)
)
def merge_themes(spark, sf):
    merged = themes.merge_themes(c.theme_loadings(spark, sf), {"fornybar": ["fornybar", "transport"]})
    return merged.withColumn("ladning", F.col("ladning").cast("double"))


@query("threshold_class", "SELECT id, CAST(score > 50 AS INTEGER) AS klasse FROM scores", ("scores",))
def threshold_class(spark, sf):
    from themeloom.operators.models import threshold_class as above

    return c.scores(spark, sf).select("id", above("score", 50.0).alias("klasse"))


# ---- reshape ----


@query("loadings_long", """SELECT l.id, l.tema, CAST(l.ladning AS DOUBLE) AS ladning, o.utfall
       FROM loadings l LEFT JOIN outcomes o ON l.id = o.id""", ("loadings", "outcomes"))
def loadings_long(spark, sf):
    # Metadata joins one row per application, before the vector is spread over topics.
    vectors = c.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    with_meta = vectors.join(c.outcomes(spark, sf), "id", "left")
    long = reshape.vectors_to_long(with_meta, ["id", "utfall"], "embedding")
    return long.select("id", "tema", F.round(F.abs(F.col("ladning").cast("double")), 6).alias("ladning"), "utfall")


@query(
    "unpivot_themes",
    f"SELECT id, tema, flag FROM flags UNPIVOT INCLUDE NULLS (flag FOR tema IN ({', '.join(c.MERGED)}))",
    ("flags",),
)
def unpivot_themes(spark, sf):
    return reshape.to_long(c.theme_flags(spark, sf), ["id"], c.MERGED, "tema", "flag")


@query(
    "pivot_themes",
    "SELECT id, " + ", ".join(f"CAST({t} AS DOUBLE) AS {t}" for t in c.THEMES)
    + f" FROM (PIVOT themes ON tema IN ({c.sql_list(c.THEMES)}) USING first(ladning) GROUP BY id)",
    ("themes",),
)
def pivot_themes(spark, sf):
    wide = reshape.to_wide(c.theme_loadings(spark, sf), ["id"], "tema", c.THEMES, "ladning")
    return cleaning.map_columns(wide, c.THEMES, lambda x: x.cast("double"))


@query(
    "explode_parallel",
    """SELECT id, round(CAST(v AS DOUBLE), 6) AS verdi, plass
       FROM (SELECT vec_id AS id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS plass
             FROM embeddings)""",
)
def explode_parallel(spark, sf):
    vectors = c.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("verdi"),
        F.sequence(F.lit(1).cast("long"), F.size("embedding").cast("long")).alias("plass"),
    )
    return reshape.explode_parallel(vectors, ["id"], ["verdi", "plass"])


# ---- joins ----


@query(
    "join_applications",
    """SELECT h.id, h.tema, CAST(h.ladning AS DOUBLE) AS ladning, a.saknummer, a.utfall, a.omsoktbelop
       FROM high h LEFT JOIN apps a ON h.id = a.id""",
    ("high", "apps"),
)
def join_applications(spark, sf):
    high = themes.high_loading(c.theme_loadings(spark, sf))
    wanted = c.applications(spark, sf).select("id", "saknummer", "utfall", "omsoktbelop")
    return high.join(wanted, "id", "left").withColumn("ladning", F.col("ladning").cast("double"))


@query(
    "join_registry",
    """SELECT a.id, a.org_nr, a.aar, r.navn, r.org_form, r.fylke, r.alder, r.oms, substr(r.nace1_sn07, 1, 2) AS nace
       FROM apps a LEFT JOIN (SELECT * FROM registry WHERE org_nr <> '') r
         ON a.org_nr IS NOT DISTINCT FROM r.org_nr AND a.aar = r.aar""",
    ("apps", "registry"),
)
def join_registry(spark, sf):
    # The registry is cleaned first, so missing ids have no rows to meet.
    apps = c.application_parts(spark, sf).select("id", "org_nr", "aar")
    joined = registry.join_registry(apps, c.clean_full_registry(spark, sf))
    return joined.select("id", "org_nr", "aar", "navn", "org_form", "fylke", "alder", "oms", "nace")


@query(
    "registry_fan_out",
    """SELECT max(a.n) AS soknader, max(r.n) AS registerrader, max(a.n * r.n) AS rader
       FROM (SELECT org_nr, aar, count(*) AS n FROM apps GROUP BY ALL) a
       JOIN (SELECT org_nr, aar, count(*) AS n FROM registry WHERE org_nr <> '' GROUP BY ALL) r
         ON a.org_nr = r.org_nr AND a.aar = r.aar""",
    ("apps", "registry"),
)
def registry_fan_out(spark, sf):
    return registry.largest_fan_out(c.application_parts(spark, sf), c.clean_full_registry(spark, sf))


@query(
    "join_registry_known",
    """SELECT a.id, a.org_nr, r.org_form, r.alder FROM apps a
       LEFT JOIN registry r ON a.org_nr = r.org_nr AND a.aar = r.aar""",
    ("apps", "registry"),
)
def join_registry_known(spark, sf):
    apps = c.application_parts(spark, sf).select("id", "org_nr", "aar")
    joined = registry.join_registry(apps, c.full_registry(spark, sf), null_keys="never")
    return joined.select("id", "org_nr", "org_form", "alder")


@query(
    "anti_join_natural",
    "SELECT org_nr, n FROM repeat_firms f WHERE NOT EXISTS (SELECT 1 FROM repeat_pairs p WHERE p.org_nr = f.org_nr AND p.n = f.n)",
    ("repeat_firms", "repeat_pairs"),
)
def anti_join_natural(spark, sf):
    pairs = themes.count_by(c.high_firm_theme(spark, sf), ["org_nr", "tema"])
    firms = pairs.groupBy("org_nr").agg(F.sum("n").alias("n")).where("n > 1")
    return joins.anti_join_natural(firms, pairs.where("n > 1"))


# ---- registry ----


@query("registry_clean", "SELECT * FROM registry_late", ("registry_late",))
def registry_clean(spark, sf):
    return registry.clean_registry(c.snapshot(spark, sf), c.SNAPSHOT_YEAR)


@query(
    "registry_age",
    "SELECT org_nr, navn, aar, opprettet, alder FROM registry_early",
    ("registry_early",),
)
def registry_age(spark, sf):
    return registry.with_age(c.yearly_extracts(spark, sf)).select("org_nr", "navn", "aar", "opprettet", "alder")


@query("registry_union", "SELECT * FROM registry", ("registry",))
def registry_union(spark, sf):
    return c.full_registry(spark, sf)


@query(
    "distinct_edges", "SELECT DISTINCT org_nr, tema FROM high_firms", ("high_firms",)
)
def distinct_edges(spark, sf):
    return c.high_firm_theme(spark, sf).select("org_nr", "tema").distinct()


@query(
    "one_per_firm",
    """SELECT org_nr, aar, org_form, oms FROM registry WHERE org_nr <> ''
       QUALIFY row_number() OVER (PARTITION BY org_nr ORDER BY aar) = 1""",
    ("registry",),
)
def one_per_firm(spark, sf):
    known = c.full_registry(spark, sf).withColumn("org_nr", blank_to_null("org_nr")).dropna(subset=["org_nr"])
    return themes.one_per_firm(known.select("org_nr", "aar", "org_form", "oms"), "org_nr", ["aar"])


# ---- the flagship question ----


@query(
    "any_theme_by_dim",
    "SELECT fylke2, CAST(count(*) FILTER (flag = 0) AS BIGINT) AS uten, CAST(count(*) FILTER (flag = 1) AS BIGINT) AS med, "
    "round(count(*) FILTER (flag = 1) * 100.0::DOUBLE / nullif(count(flag), 0), 6) AS prosent "
    "FROM (SELECT fylke2, greatest(" + ", ".join(c.MERGED) + ") AS flag FROM analysis) "
    "WHERE fylke2 IS NOT NULL GROUP BY fylke2 HAVING count(flag) > 0",
    ("analysis",),
)
def any_theme_by_dim(spark, sf):
    from themeloom.operators.crosstab import any_theme_by_dim as by_dim

    return by_dim(c.analysis(spark, sf), c.MERGED, "fylke2")


@query(
    "theme_share_total",
    """SELECT count(*) FILTER (tema IN (SELECT code FROM theme_map)) AS treff, count(*) AS alle,
         round(count(*) FILTER (tema IN (SELECT code FROM theme_map)) * 100.0::DOUBLE / count(*), 6) AS prosent
       FROM (SELECT * FROM loadings
             QUALIFY ladning * count(*) OVER (PARTITION BY tema) >= sum(ladning) OVER (PARTITION BY tema))""",
    ("loadings", "theme_map"),
)
def theme_share_total(spark, sf):
    high = themes.high_loading(c.loadings(spark, sf))
    return themes.share_of(high, F.col("tema").isin(list(c.TOPIC_THEMES)))


@query(
    "with_total",
    """SELECT tema, n, CAST(sum(n) OVER () AS BIGINT) AS sum, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS prosent
       FROM (SELECT tema, count(*) AS n FROM high GROUP BY tema)""",
    ("high",),
)
def with_total(spark, sf):
    counts = themes.count_by(themes.high_loading(c.theme_loadings(spark, sf)), ["tema"])
    return themes.with_total(counts, "n").withColumn("prosent", F.round(percent("n", "sum"), 6))
