"""Words, vocabulary, tf-idf and topic quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from themeloom.operators import cleaning, text, topics
from themeloom.plans import catalog as c
from themeloom.plans.catalog import query
from themeloom.sources import cut_lineage, lookups

# Function words left out in the checked query.
COMMON = ["the", "a", "an", "that", "this", "it", "in", "at", "with", "of", "el", "la", "le", "les", "un", "une",
          "de", "den", "der", "die", "das", "que", "qui", "en"]


@query("tokenize", "SELECT word, count(*) AS n, count(DISTINCT id) AS df FROM tokens GROUP BY word", ("tokens",))
def tokenize(spark, sf):
    # Counted per document first, so no distinct over all words is needed.
    counts = c.all_counts(spark, sf)
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))


@query("term_counts", "SELECT id, word, n FROM counts ORDER BY n DESC, id, word", ("counts",))
def term_counts(spark, sf):
    return c.all_counts(spark, sf).orderBy(F.desc("n"), "id", "word")


@query(
    "doc_term_counts",
    rf"""SELECT doc_id AS id, word, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(
                 lower(regexp_replace(text, '(https?://|www\.)\S+', ' ', 'g')), '[\p{{L}}\p{{N}}]+')) AS word
               FROM documents)
         WHERE NOT regexp_matches(word, '^\p{{N}}+$') AND word NOT IN ({c.sql_list(COMMON)})
         GROUP BY ALL""",
)
def doc_term_counts(spark, sf):
    return text.counted_words(c.texts(spark, sf), "id", "text", drop_urls=True, stopwords=COMMON, drop_numbers=True)


@query("trim_vocabulary", "SELECT id, word, n FROM trimmed", ("trimmed",))
def trim_vocabulary(spark, sf):
    return text.trim_vocabulary(cut_lineage(c.all_counts(spark, sf)), c.n_docs(spark, sf), 0.01, 0.999)


@query(
    "tf_idf",
    """SELECT id, word, n, round(n / total, 9) AS tf, round(ln(docs / df), 9) AS idf,
         round(n / total * ln(docs / df), 9) AS tf_idf
       FROM (SELECT id, word, n, sum(n) OVER (PARTITION BY id) AS total, count(*) OVER (PARTITION BY word) AS df,
               (SELECT count(DISTINCT id) FROM counts) AS docs FROM counts)""",
    ("counts",),
)
def tf_idf(spark, sf):
    weights = text.tf_idf(c.all_counts_with_totals(spark, sf), total="total")
    return weights.select("id", "word", "n", *[F.round(x, 9).alias(x) for x in ("tf", "idf", "tf_idf")])


@query(
    "reorder_terms",
    """SELECT word, median, dense_rank() OVER (ORDER BY median) AS ord
       FROM (SELECT word, round(quantile_cont(x, 0.5), 9) AS median
             FROM (SELECT word, round(n / total * ln(docs / df), 12) AS x
                   FROM (SELECT id, word, n, sum(n) OVER (PARTITION BY id) AS total,
                           count(*) OVER (PARTITION BY word) AS df,
                           (SELECT count(DISTINCT id) FROM counts) AS docs FROM counts)) GROUP BY word)""",
    ("counts",),
)
def reorder_terms(spark, sf):
    weights = text.tf_idf(c.all_counts_with_totals(spark, sf), total="total").select("word", F.round("tf_idf", 12).alias("tf_idf"))
    return cleaning.reorder_levels(weights, "word", "tf_idf")


def _vocabulary(spark, sf, split):
    present = split.select("id", F.explode(F.array_distinct("words")).alias("word"))
    return text.term_list(text.vocabulary(present, c.n_docs(spark, sf), 0.01, 0.999))


@query(
    "doc_vectors",
    """SELECT id, total AS n_words, CAST(count(*) AS BIGINT) AS ulike, CAST(sum(n) AS DOUBLE) AS antall
       FROM (SELECT t.id, t.n, a.total FROM trimmed t
             JOIN (SELECT id, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY id) a ON a.id = t.id)
       GROUP BY id, total""",
    ("trimmed", "counts"),
)
def doc_vectors(spark, sf):
    split = c.stored_words(spark, sf)
    words = [w for w, _ in _vocabulary(spark, sf, split)]
    vectors = text.drop_empty(cut_lineage(text.doc_vectors(split, words)))
    parts = F.unwrap_udt("features")
    total = F.aggregate(parts["values"], F.lit(0.0), lambda a, x: a + x)
    return vectors.select("id", "n_words", F.size(parts["indices"]).cast("long").alias("ulike"), total.alias("antall"))


@query(
    "tfidf_vectors",
    """SELECT id, CAST(count(*) AS BIGINT) AS ulike, round(sum(n / total * ln(docs / df)), 6) AS tf_idf
       FROM (SELECT t.id, t.n, a.total, v.df, (SELECT count(DISTINCT id) FROM counts) AS docs FROM trimmed t
             JOIN vocabulary v ON v.word = t.word
             JOIN (SELECT id, sum(n) AS total FROM counts GROUP BY id) a ON a.id = t.id)
       GROUP BY id""",
    ("trimmed", "vocabulary", "counts"),
)
def tfidf_vectors(spark, sf):
    split = c.stored_words(spark, sf)
    terms = _vocabulary(spark, sf, split)
    vectors = text.drop_empty(text.tfidf_vectors(split, terms, split.where(F.size("words") > 0).count()))
    parts = F.unwrap_udt("features")
    total = F.aggregate(parts["values"], F.lit(0.0), lambda a, x: a + x)
    return vectors.select("id", F.size(parts["indices"]).cast("long").alias("ulike"), F.round(total, 6).alias("tf_idf"))


# ---- topic quality on given shares ----


@query(
    "heldout_split",
    """SELECT id, word, n, CASE WHEN ('0x' || substr(md5('1|' || id), 1, 8))::BIGINT % 100 < 10
              AND ('0x' || substr(md5('1|' || id || '|' || word), 1, 8))::BIGINT % 100 < 50
            THEN 'utelatt' ELSE 'trening' END AS del FROM trimmed""",
    ("trimmed",),
)
def heldout_split(spark, sf):
    train, held = topics.heldout_split(c.trimmed_counts(spark, sf))
    return train.withColumn("del", F.lit("trening")).unionByName(held.withColumn("del", F.lit("utelatt")))


@query(
    "heldout_likelihood",
    """SELECT round(avg(d), 6) AS likelihood, count(d) AS documents
       FROM (SELECT id, sum(n * ln(q)) / sum(n) AS d FROM rates
             WHERE ('0x' || substr(md5('1|' || id), 1, 8))::BIGINT % 100 < 10
               AND ('0x' || substr(md5('1|' || id || '|' || word), 1, 8))::BIGINT % 100 < 50 GROUP BY id)""",
    ("rates",),
)
def heldout_likelihood(spark, sf):
    trimmed = c.trimmed_counts(spark, sf)
    _, held = topics.heldout_split(trimmed)
    return topics.heldout_likelihood(held, c.given_theta(spark, sf), c.given_beta(spark, sf, trimmed))


COHERENCE = """SELECT topic, round(sum(ln((both_docs + 0.01::DOUBLE) / (high_docs + 0.01::DOUBLE))), 6) AS coherence
  FROM (SELECT a.topic, a.word, b.word,
          (SELECT count(*) FROM trimmed t WHERE t.word = a.word) AS high_docs,
          (SELECT count(*) FROM trimmed t JOIN trimmed u ON t.id = u.id WHERE t.word = a.word AND u.word = b.word)
            AS both_docs
        FROM top10 a JOIN top10 b ON a.topic = b.topic AND a.rank < b.rank) GROUP BY topic"""


@query("semantic_coherence", COHERENCE, ("trimmed", "top10"))
def semantic_coherence(spark, sf):
    trimmed = c.trimmed_counts(spark, sf)
    return topics.semantic_coherence(trimmed, topics.top_words(c.given_beta(spark, sf, trimmed), 10))


EXCLUSIVITY = """SELECT f.topic, round(sum(f.frex), 6) AS exclusivity
  FROM frex f JOIN top10 t ON f.topic = t.topic AND f.word = t.word GROUP BY f.topic"""


@query("topic_exclusivity", EXCLUSIVITY, ("frex", "top10"))
def topic_exclusivity(spark, sf):
    return topics.exclusivity(c.given_beta(spark, sf))


@query(
    "topic_quality",
    f"SELECT c.topic, coherence, exclusivity FROM ({COHERENCE}) c JOIN ({EXCLUSIVITY}) e ON c.topic = e.topic",
    ("trimmed", "top10", "frex"),
)
def topic_quality(spark, sf):
    trimmed = c.trimmed_counts(spark, sf)
    return topics.topic_quality(trimmed, c.given_beta(spark, sf, trimmed))


@query(
    "topic_frex",
    """SELECT topic, word, round(fr, 9) AS fr, round(ex, 9) AS ex, round(frex, 9) AS frex FROM frex""",
    ("frex",),
)
def topic_frex(spark, sf):
    scored = topics.frex_scores(c.given_beta(spark, sf), 0.7)
    return scored.select("topic", "word", *[F.round(x, 9).alias(x) for x in ("fr", "ex", "frex")])


@query("top_terms", "SELECT topic, word, round(p, 9) AS p, rank FROM top10", ("top10",))
def top_terms(spark, sf):
    return topics.top_words(c.given_beta(spark, sf), 10).select("topic", "word", F.round("p", 9).alias("p"), "rank")


@query(
    "topic_labels",
    """SELECT a.topic, a.sannsynlighet, b.frex
       FROM (SELECT topic, string_agg(word, ' ' ORDER BY p DESC, word) AS sannsynlighet
             FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY p DESC, word) AS k FROM beta)
             WHERE k <= 100 GROUP BY topic) a
       JOIN (SELECT topic, string_agg(word, ' ' ORDER BY f DESC, word) AS frex
             FROM (SELECT topic, word, f, row_number() OVER (PARTITION BY topic ORDER BY f DESC, word) AS k
                   FROM (SELECT topic, word, round(1 / (0.5::DOUBLE / ex + 0.5::DOUBLE / fr), 9) AS f FROM frex))
             WHERE k <= 100 GROUP BY topic) b ON a.topic = b.topic""",
    ("beta", "frex"),
)
def topic_labels(spark, sf):
    return topics.label_topics(c.given_beta(spark, sf))


@query(
    "residual_dispersion",
    """SELECT round(d, 3) AS avvik, CAST(df AS BIGINT) AS frihetsgrader, round(d / df, 6) AS dispersion
       FROM (SELECT sum((coalesce(c.n, 0) - x.m * x.q) ** 2 / (x.m * x.q * (1 - x.q))
                 - x.m * x.q / (1 - x.q) + x.m * x.q / (1 - x.q)) AS d,
               count(*) FILTER (x.m * x.q > 0.01) - (count(DISTINCT x.id) * 3
                 + 4 * ((SELECT count(*) FROM vocabulary) - 1)) AS df
             FROM (SELECT m.id, m.m, v.word, sum(t.p * b.p) AS q
                   FROM (SELECT id, CAST(sum(n) AS BIGINT) AS m FROM trimmed GROUP BY id) m
                   JOIN theta t ON t.id = m.id JOIN beta b ON b.topic = t.topic
                   JOIN vocabulary v ON v.word = b.word GROUP BY m.id, m.m, v.word) x
             LEFT JOIN trimmed c ON c.id = x.id AND c.word = x.word)""",
    ("trimmed", "theta", "beta", "vocabulary"),
)
def residual_dispersion(spark, sf):
    trimmed = c.trimmed_counts(spark, sf)
    return topics.residual_dispersion(trimmed, c.given_theta(spark, sf), c.given_beta(spark, sf, trimmed), rest=1e-12)


@query(
    "topic_prevalence",
    f"""SELECT tema, round(CAST(sum(ladning) AS DOUBLE) / count(*), 6) AS andel, label
        FROM loadings JOIN theme_map ON tema = code WHERE tema IN ({c.sql_list(c.TOPIC_THEMES)}) GROUP BY tema, label""",
    ("loadings", "theme_map"),
)
def topic_prevalence(spark, sf):
    labels = lookups.as_table(spark, c.TOPIC_THEMES).withColumnRenamed("code", "tema")
    return topics.topic_prevalence(c.loadings(spark, sf), list(c.TOPIC_THEMES), labels)


# ---- fitted topics ----


def _fitted(spark, sf, k=5, max_iter=10):
    split = c.stored_words(spark, sf)
    words = [w for w, _ in _vocabulary(spark, sf, split)]
    # Every iteration of the fit reads the vectors.
    vectors = text.drop_empty(cut_lineage(text.doc_vectors(split, words)))
    return topics.fit_topics(vectors, k, max_iter=max_iter), vectors, words


@query("topic_fit")
def topic_fit(spark, sf):
    model, vectors, _ = _fitted(spark, sf)
    return topics.model_theta(model, vectors).withColumn("p", F.round("p", 6))


@query("topic_fit_labels")
def topic_fit_labels(spark, sf):
    model, _, words = _fitted(spark, sf)
    return topics.label_topics(topics.model_beta(model, words), 20)


@query("topic_k_metrics")
def topic_k_metrics(spark, sf):
    split = c.stored_words(spark, sf).where(F.size("words") > 0)
    words = [w for w, _ in _vocabulary(spark, sf, split)]
    # Words are counted in the vocabulary alone, so rare ones are never sorted, written or joined.
    trimmed = cut_lineage(text.vector_counts(text.doc_vectors(split, words), words))
    # Many steps read the parts; the digests that part them are made once.
    train, held = map(cut_lineage, topics.heldout_split(trimmed))
    vectors = text.drop_empty(cut_lineage(text.count_vectors(train, words)))
    return topics.sweep_topics(vectors, train, held, words, ks=(4, 8))
