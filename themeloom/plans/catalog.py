"""Catalogue of queries, and the stand-in tables both engines build from the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import blank_to_null, to_fixed
from themeloom.operators import cleaning, registry, reshape, text, themes, word_features
from themeloom.sources import cut_lineage, lookups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def in_test_vector(topics: dict[str, str]) -> dict[str, str]:
    """The themes under topic numbers that the test vectors with 64 numbers have."""
    number = lambda code: {"V80": "V50"}.get(code) or (f"V{int(code[1:]) - 40}" if int(code[1:]) > 64 else code)
    return {number(code): theme for code, theme in topics.items()}


TOPIC_THEMES = in_test_vector(lookups.SUSTAINABILITY)
INDUSTRY_FOUR = in_test_vector(lookups.INDUSTRY_FOUR)
THEMES = list(TOPIC_THEMES.values())
MERGED = [t for t in THEMES if t != "transport"]
LANGS = ["de", "en", "es", "fr"]
MODEL_THEMES = [f"V{i}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21)]
FIELDS = [f"field_{k}" for k in range(1, 7)]
YEARS = [str(y) for y in range(1995, 2001)]
SNAPSHOT_YEAR = "2001"


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query and, where SQL can say the same, its SQL over the named parts."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = compose(sql, uses)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- Spark stand-ins ----


def loadings(spark: SparkSession, sf: str, topics: list[str] | None = None) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    long = reshape.vectors_to_long(vectors, ["id"], "embedding", topics=topics)
    return long.withColumn("ladning", to_fixed(F.round(F.abs(F.col("ladning").cast("double")), 6)))


def wide_loadings(spark: SparkSession, sf: str, topics: dict[str, str]) -> DataFrame:
    """One column per chosen topic, straight from the vector: a row holds all of them already."""
    value = lambda code: F.get("embedding", F.lit(int(code[1:]) - 1)).cast("double")
    columns = [to_fixed(F.round(F.abs(value(code)), 6)).alias(name) for code, name in topics.items()]
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *columns)


def theme_loadings(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings of the chosen topics under their theme names."""
    return cleaning.recode(loadings(spark, sf, list(TOPIC_THEMES)), "tema", TOPIC_THEMES, "tema")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def application_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Application columns that come from the documents alone."""
    docs = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "source": "type"})
    part = lambda k: F.nullif(F.split_part("text", F.lit(". "), F.lit(k)), F.lit(""))
    return docs.withColumns(
        {f"field_{k}": part(k) for k in range(1, 7)}
        | {
            "omsoktbelop": F.col("n_chars") * 100,
            "saknummer": F.concat((2013 + F.col("id") % 7).cast("string"), F.lit("/"), F.col("id").cast("string")),
            "org_nr": F.when(F.col("id") % 50 != 0, (F.col("id") % 1500).cast("string")),
            "aar": (1995 + F.col("id") % 7).cast("string"),
        }
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    quality = F.col("quality")
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(quality == 1, "Innvilget").when(quality == 0, "Avslatt").alias("utfall"),
    )


def applications(spark: SparkSession, sf: str) -> DataFrame:
    joined = application_parts(spark, sf).join(outcomes(spark, sf), "id", "left")
    return joined.withColumn("innvilgetbelop", F.when(F.col("utfall") == "Innvilget", F.col("omsoktbelop")))


def registry_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer and year of its orders; the customer attributes join after the grouping."""
    yearly = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("string").alias("aar"))
        .agg(
            F.count(F.lit(1)).cast("string").alias("syss"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("oms"),
        )
    )
    k = F.col("c_custkey")
    county = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    return yearly.join(table(spark, sf, "customer"), "c_custkey").select(
        F.when(k % 50 == 1, "").when(k % 50 != 0, k.cast("string")).alias("org_nr"),
        F.col("c_name").alias("navn"),
        F.concat((1960 + k % 35).cast("string"), F.lit("-01-01")).alias("fnr_dat"),
        F.concat(F.lpad((k % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0")).alias(
            "nace1_sn07"
        ),
        "syss",
        F.when(k % 40 == 0, "BEDR").otherwise(F.col("c_mktsegment")).alias("org_form"),
        county.alias("fylke"),
        F.concat(county, F.lpad((k % 100).cast("string"), 2, "0")).alias("kommune"),
        "oms",
        "aar",
    )


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Last year in the layout of a snapshot."""
    raw = registry_raw(spark, sf).where(F.col("aar") == SNAPSHOT_YEAR)
    return raw.drop("fylke", "aar").withColumnsRenamed({"fnr_dat": "orgnrdat", "kommune": "fkommune"})


def yearly_extracts(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier years in the layout of the yearly extracts."""
    raw = registry_raw(spark, sf).where(F.col("aar") < SNAPSHOT_YEAR)
    return raw.withColumnsRenamed({"org_nr": "ORG_NR", "navn": "NAVN", "org_form": "ORG_FORM"})


def full_registry(spark: SparkSession, sf: str) -> DataFrame:
    """All years from one pass over the source; the last one has the layout of a snapshot."""
    return registry.clean_years(registry_raw(spark, sf), SNAPSHOT_YEAR)


def clean_full_registry(spark: SparkSession, sf: str) -> DataFrame:
    return full_registry(spark, sf).withColumn("org_nr", blank_to_null("org_nr")).dropna(subset=["org_nr"])


def merged_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_loadings(spark, sf, TOPIC_THEMES)
    return themes.merge_columns(wide, {"fornybar": ["fornybar", "transport"]})


def theme_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Wide 0/1 flags per application, correlated themes merged."""
    return cleaning.dichotomise_wide(merged_wide(spark, sf), MERGED).select("id", *MERGED)


def analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Flags, outcome and firm attributes, one row per application."""
    # Flags, firm and year all come from the row of the application: one projection, no join by id.
    applicants = theme_flags(spark, sf).withColumns(
        {
            "org_nr": F.when(F.col("id") % 50 != 0, (F.col("id") % 1500).cast("string")),
            "aar": (1995 + F.col("id") % 7).cast("string"),
        }
    )
    firm = clean_full_registry(spark, sf).select("org_nr", "aar", "nace1_sn07", "syss", "org_form", "fylke", "alder")
    joined = registry.join_registry(applicants, firm, null_keys="never")
    county = cleaning.recode(joined, "fylke", lookups.COUNTIES, "fylke2", default="null")
    dims = cleaning.recode(county, "nace", lookups.sectors(), "nace2", null_codes=["00"])
    return dims.join(outcomes(spark, sf), "id", "left")


def analysis_long(spark: SparkSession, sf: str) -> DataFrame:
    dims = ["id", "utfall", "fylke2", "nace2", "org_form", "alder", "org_nr"]
    return reshape.to_long(analysis(spark, sf).select(*dims, *MERGED), dims, MERGED, "tema", "flag")


def firm_theme(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("org_nr"),
        F.col("p_type").alias("tema"),
        F.col("l_quantity").alias("ladning"),
    )


def high_firm_theme(spark: SparkSession, sf: str) -> DataFrame:
    return themes.high_loading(firm_theme(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        F.round("value", 2).alias("score"),
    )


def stored_words(spark: SparkSession, sf: str) -> DataFrame:
    """Word arrays, written once where both counts and vectors are made of them."""
    return cut_lineage(text.split_words(texts(spark, sf), "id", "text"))


def all_counts(spark: SparkSession, sf: str) -> DataFrame:
    return text.counted_words(texts(spark, sf), "id", "text")


def all_counts_with_totals(spark: SparkSession, sf: str) -> DataFrame:
    return text.counted_words(texts(spark, sf), "id", "text", total="total")


def n_docs(spark: SparkSession, sf: str):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()


def trimmed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed matrix; counts and trimmed rows are stored, as several steps read them."""
    counts = cut_lineage(all_counts(spark, sf))
    return cut_lineage(text.trim_vocabulary(counts, n_docs(spark, sf), 0.01, 0.999))


def given_theta(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    topics = F.explode(F.array(*[F.lit(t) for t in LANGS])).alias("topic")
    return docs.select("id", "lang", topics).select(
        "id", "topic", F.when(F.col("topic") == F.col("lang"), 0.7).otherwise(0.1).alias("p")
    )


def given_beta(spark: SparkSession, sf: str, trimmed: DataFrame | None = None) -> DataFrame:
    """Smoothed word shares per language over the trimmed vocabulary."""
    trimmed = trimmed_counts(spark, sf) if trimmed is None else trimmed
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"))
    counts = trimmed.join(lang, "id").groupBy("topic", "word").agg(F.sum("n").alias("n"))
    per_topic = [F.sum(F.when(F.col("topic") == t, F.col("n")).otherwise(0)) for t in LANGS]
    words = counts.groupBy("word").agg(F.array(*per_topic).alias("ns"))
    sizes = words.agg(
        F.struct(F.count(F.lit(1)).alias("v"), F.array(*[F.sum(F.col("ns")[i]) for i in range(len(LANGS))]).alias("n")).alias(
            "s"
        )
    ).scalar()
    rates = [
        F.struct(
            F.lit(t).alias("topic"),
            ((F.col("ns")[i] + 1) / (sizes.getField("n")[i] + sizes.getField("v"))).alias("p"),
        )
        for i, t in enumerate(LANGS)
    ]
    return cut_lineage(words.select("word", F.inline(F.array(*rates))).select("topic", "word", "p"))


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty themes as features, and whether the application is about renewable energy."""
    wanted = [*MODEL_THEMES, "V7"]
    wide = wide_loadings(spark, sf, {t: t for t in wanted})
    flagged = cleaning.dichotomise_wide(wide, ["V7"]).withColumnRenamed("V7", "label")
    return cleaning.map_columns(flagged, MODEL_THEMES, lambda c: c.cast("double")).dropna("any")


def training_table(spark: SparkSession, sf: str, cells: int = word_features.CELLS) -> DataFrame:
    """Themes and words of each application in one sparse vector: twenty numbers, then the cells of the words."""
    rows = cut_lineage(model_table(spark, sf))
    wanted = texts(spark, sf).join(rows.select("id"), "id", "left_semi")  # whole texts, before they become words
    own = text.counted_words(wanted, "id", "text", total="total")
    return word_features.assemble(rows, all_counts_with_totals(spark, sf), MODEL_THEMES, cells=cells, own=own)


# ---- SQL stand-ins ----


def _values(rows) -> str:
    quoted = ["(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows]
    return ", ".join(quoted)


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _flag_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} * count({c}) OVER () >= sum({c}) OVER () THEN 1 ELSE 0 END"


PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "loadings": (
        """SELECT id, 'V' || CAST(i AS VARCHAR) AS tema,
             CAST(round(abs(CAST(v AS DOUBLE)), 6) AS DECIMAL(18,6)) AS ladning
           FROM (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v
                 FROM embeddings)""",
        (),
    ),
    "theme_map": (f"SELECT * FROM (VALUES {_values(TOPIC_THEMES.items())}) AS t(code, label)", ()),
    "theme_labels": (f"SELECT * FROM (VALUES {_values(lookups.THEME_LABELS.items())}) AS t(code, label)", ()),
    "counties": (f"SELECT * FROM (VALUES {_values(lookups.COUNTIES.items())}) AS t(code, label)", ()),
    "sectors": (
        f"SELECT * FROM (VALUES {_values(lookups.SECTOR_RANGES)}) AS t(first_code, last_code, label)",
        (),
    ),
    "themes": (
        "SELECT l.id, m.label AS tema, l.ladning FROM loadings l JOIN theme_map m ON l.tema = m.code",
        ("loadings", "theme_map"),
    ),
    "high": (
        """SELECT * FROM themes
           QUALIFY ladning * count(*) OVER (PARTITION BY tema) >= sum(ladning) OVER (PARTITION BY tema)""",
        ("themes",),
    ),
    "merged": (
        """SELECT id, tema, CAST(ladning AS DECIMAL(19,7)) AS ladning FROM themes
             WHERE tema NOT IN ('fornybar', 'transport')
           UNION ALL
           SELECT f.id, 'fornybar', CAST((f.ladning + t.ladning) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(19,7))
           FROM themes f JOIN themes t ON f.id = t.id AND f.tema = 'fornybar' AND t.tema = 'transport'""",
        ("themes",),
    ),
    "outcomes": (
        """SELECT doc_id AS id, CASE quality WHEN 1 THEN 'Innvilget' WHEN 0 THEN 'Avslatt' END AS utfall
           FROM labels""",
        (),
    ),
    "apps": (
        "SELECT d.doc_id AS id, d.text, d.lang, d.source AS type, o.utfall, "
        + ", ".join(f"nullif(split_part(d.text, '. ', {k}), '') AS field_{k}" for k in range(1, 7))
        + """, d.n_chars * 100 AS omsoktbelop,
             CASE WHEN o.utfall = 'Innvilget' THEN d.n_chars * 100 END AS innvilgetbelop,
             CAST(2013 + d.doc_id % 7 AS VARCHAR) || '/' || CAST(d.doc_id AS VARCHAR) AS saknummer,
             CASE WHEN d.doc_id % 50 <> 0 THEN CAST(d.doc_id % 1500 AS VARCHAR) END AS org_nr,
             CAST(1995 + d.doc_id % 7 AS VARCHAR) AS aar
           FROM documents d LEFT JOIN outcomes o ON d.doc_id = o.id""",
        ("outcomes",),
    ),
    "registry_raw": (
        """SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN ''
                    ELSE CAST(c_custkey AS VARCHAR) END AS org_nr,
             c_name AS navn, CAST(1960 + c_custkey % 35 AS VARCHAR) || '-01-01' AS fnr_dat,
             lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
               AS nace1_sn07,
             syss, CASE WHEN c_custkey % 40 = 0 THEN 'BEDR' ELSE c_mktsegment END AS org_form,
             lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS fylke,
             lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS kommune,
             oms, aar
           FROM (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS aar, CAST(count(*) AS VARCHAR) AS syss,
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS oms
                 FROM orders GROUP BY ALL)
           JOIN customer ON o_custkey = c_custkey""",
        (),
    ),
    "registry_late": (
        f"""SELECT org_nr, navn, nace1_sn07, syss, org_form, substr(kommune, 1, 2) AS fylke, kommune, oms, aar,
             substr(fnr_dat, 1, 4) AS opprettet, CAST(aar AS BIGINT) - CAST(substr(fnr_dat, 1, 4) AS BIGINT) AS alder
           FROM registry_raw WHERE aar = '{SNAPSHOT_YEAR}' AND org_form <> 'BEDR' AND org_nr <> ''""",
        ("registry_raw",),
    ),
    "registry_early": (
        f"""SELECT org_nr, navn, nace1_sn07, syss, org_form, fylke, kommune, oms, aar,
             substr(fnr_dat, 1, 4) AS opprettet, CAST(aar AS BIGINT) - CAST(substr(fnr_dat, 1, 4) AS BIGINT) AS alder
           FROM registry_raw WHERE aar < '{SNAPSHOT_YEAR}'""",
        ("registry_raw",),
    ),
    "registry": (
        "SELECT * FROM registry_late UNION ALL BY NAME SELECT * FROM registry_early",
        ("registry_late", "registry_early"),
    ),
    "wide": (
        "SELECT id, "
        + ", ".join(f"max(ladning) FILTER (tema = '{t}') AS {t}" for t in MERGED)
        + " FROM merged GROUP BY id",
        ("merged",),
    ),
    "flags": ("SELECT id, " + ", ".join(f"{_flag_sql(t)} AS {t}" for t in MERGED) + " FROM wide", ("wide",)),
    "analysis": (
        "SELECT f.id, o.utfall, c.label AS fylke2, "
        "CASE WHEN substr(r.nace1_sn07, 1, 2) <> '00' THEN coalesce(s.label, substr(r.nace1_sn07, 1, 2)) END AS nace2, "
        "r.org_form, r.alder, r.syss, CASE WHEN f.id % 50 <> 0 THEN CAST(f.id % 1500 AS VARCHAR) END AS org_nr, "
        + ", ".join(f"f.{t}" for t in MERGED)
        + """ FROM flags f LEFT JOIN outcomes o ON f.id = o.id
           LEFT JOIN (SELECT * FROM registry WHERE org_nr <> '') r
             ON f.id % 50 <> 0 AND r.org_nr = CAST(f.id % 1500 AS VARCHAR)
             AND r.aar = CAST(1995 + f.id % 7 AS VARCHAR)
           LEFT JOIN counties c ON r.fylke = c.code
           LEFT JOIN sectors s
             ON CAST(substr(r.nace1_sn07, 1, 2) AS INTEGER) BETWEEN s.first_code AND s.last_code""",
        ("flags", "outcomes", "registry", "counties", "sectors"),
    ),
    "analysis_long": (
        f"SELECT * FROM analysis UNPIVOT INCLUDE NULLS (flag FOR tema IN ({', '.join(MERGED)}))",
        ("analysis",),
    ),
    "firm_theme": (
        """SELECT CAST(l_orderkey AS VARCHAR) AS org_nr, p_type AS tema, l_quantity AS ladning
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
        (),
    ),
    "high_firms": (
        """SELECT * FROM (SELECT *, CAST(ladning AS DECIMAL(18,6)) AS x FROM firm_theme)
           QUALIFY x * count(*) OVER (PARTITION BY tema) >= sum(x) OVER (PARTITION BY tema)""",
        ("firm_theme",),
    ),
    "repeat_firms": (
        "SELECT org_nr, count(*) AS n FROM high_firms GROUP BY org_nr HAVING count(*) > 1",
        ("high_firms",),
    ),
    "repeat_pairs": (
        "SELECT org_nr, tema, count(*) AS n FROM high_firms GROUP BY org_nr, tema HAVING count(*) > 1",
        ("high_firms",),
    ),
    "multi_rows": (
        """SELECT f.org_nr, f.n, h.tema
           FROM (SELECT * FROM repeat_firms f WHERE NOT EXISTS (
                   SELECT 1 FROM repeat_pairs p WHERE p.org_nr = f.org_nr AND p.n = f.n)) f
           JOIN high_firms h ON h.org_nr = f.org_nr""",
        ("repeat_firms", "repeat_pairs", "high_firms"),
    ),
    "edges": ("SELECT DISTINCT org_nr, tema FROM multi_rows", ("multi_rows",)),
    "network": (
        """SELECT a.tema AS src, b.tema AS dst, count(DISTINCT a.org_nr) AS weight
           FROM edges a JOIN edges b ON a.org_nr = b.org_nr AND a.tema < b.tema GROUP BY ALL""",
        ("edges",),
    ),
    "scores": (
        """SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
             round(value, 2) AS score FROM events""",
        (),
    ),
    "tokens": (
        r"SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents",
        (),
    ),
    "counts": ("SELECT id, word, count(*) AS n FROM tokens GROUP BY ALL", ("tokens",)),
    "vocabulary": (
        """SELECT word, count(*) AS df FROM counts GROUP BY word
           HAVING count(*) >= 0.01 * (SELECT count(*) FROM documents)
              AND count(*) <= 0.999 * (SELECT count(*) FROM documents)""",
        ("counts",),
    ),
    "trimmed": ("SELECT c.* FROM counts c SEMI JOIN vocabulary v ON c.word = v.word", ("counts", "vocabulary")),
    "word_weights": (
        """SELECT c.id, c.word, c.n / a.total * ln(a.docs / d.df) AS tf_idf
           FROM counts c JOIN (SELECT word, count(*) AS df FROM counts GROUP BY word) d ON d.word = c.word
           JOIN (SELECT id, sum(n) AS total, count(*) OVER () AS docs FROM counts GROUP BY id) a ON a.id = c.id""",
        ("counts",),
    ),
    "word_cells": (
        f"""SELECT id, CAST(number // 2 AS INTEGER) AS celle, sum(CASE WHEN number % 2 = 0 THEN tf_idf ELSE -tf_idf END) AS verdi
            FROM (SELECT *, ('0x' || substr(md5('{word_features.SEED}|' || word), 1, 8))::BIGINT % {2 * word_features.CELLS} AS number
                  FROM word_weights) GROUP BY ALL""",
        ("word_weights",),
    ),
    "topics": (f"SELECT unnest([{sql_list(LANGS)}]) AS topic", ()),
    "theta": (
        """SELECT d.doc_id AS id, t.topic, CASE WHEN d.lang = t.topic THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END AS p
           FROM documents d CROSS JOIN topics t""",
        ("topics",),
    ),
    "beta": (
        """SELECT t.topic, v.word,
             (coalesce(c.n, 0) + 1) / (coalesce(s.n, 0) + (SELECT count(*) FROM vocabulary)) AS p
           FROM topics t CROSS JOIN vocabulary v
           LEFT JOIN (SELECT d.lang AS topic, x.word, CAST(sum(x.n) AS BIGINT) AS n
                      FROM trimmed x JOIN documents d ON x.id = d.doc_id GROUP BY ALL) c
             ON c.topic = t.topic AND c.word = v.word
           LEFT JOIN (SELECT d.lang AS topic, CAST(sum(x.n) AS BIGINT) AS n
                      FROM trimmed x JOIN documents d ON x.id = d.doc_id GROUP BY ALL) s ON s.topic = t.topic""",
        ("topics", "vocabulary", "trimmed"),
    ),
    "top10": (
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p DESC, word) AS rank FROM beta)
           WHERE rank <= 10""",
        ("beta",),
    ),
    "frex": (
        """SELECT topic, word, p, fr, ex, 1 / (0.7::DOUBLE / ex + 0.3::DOUBLE / fr) AS frex
           FROM (SELECT topic, word, p,
               (rank() OVER (PARTITION BY topic ORDER BY p)
                 + (count(*) OVER (PARTITION BY topic, p) - 1) / 2) / count(*) OVER (PARTITION BY topic) AS fr,
               (rank() OVER (PARTITION BY topic ORDER BY share)
                 + (count(*) OVER (PARTITION BY topic, share) - 1) / 2) / count(*) OVER (PARTITION BY topic) AS ex
             FROM (SELECT *, round(p / sum(p) OVER (PARTITION BY word), 12) AS share FROM beta))""",
        ("beta",),
    ),
    "rates": (
        """SELECT c.id, c.word, c.n, sum(t.p * b.p) AS q
           FROM trimmed c JOIN theta t ON c.id = t.id JOIN beta b ON b.topic = t.topic AND b.word = c.word
           GROUP BY c.id, c.word, c.n""",
        ("trimmed", "theta", "beta"),
    ),
    "data": ("SELECT tema, CAST(ladning AS DOUBLE) AS x FROM themes", ("themes",)),
    "places": (
        """SELECT tema, place, least(CAST(floor(place) AS BIGINT), 510) AS cell
           FROM (SELECT tema, (x - lo) / ((hi - lo) / 511) AS place
                 FROM data CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM data))""",
        ("data",),
    ),
    "model_table": (
        "SELECT id, CASE WHEN V7 * count(*) OVER () >= sum(V7) OVER () THEN 1 ELSE 0 END AS label, "
        + ", ".join(f"CAST({t} AS DOUBLE) AS {t}" for t in MODEL_THEMES)
        + " FROM (SELECT id, "
        + ", ".join(f"max(ladning) FILTER (tema = '{t}') AS {t}" for t in [*MODEL_THEMES, "V7"])
        + " FROM loadings GROUP BY id)",
        ("loadings",),
    ),
}


def compose(sql: str, uses: tuple[str, ...]) -> str:
    """Put the parts a query uses, and the parts those use, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in PARTS[name][1]:
                visit(needed)
            order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({PARTS[name][0]})" for name in order) + "\n" + sql
