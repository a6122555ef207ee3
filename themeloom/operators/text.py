"""Tokens, document-term counts, vocabulary trimming, tf-idf and sparse vectors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.joins import attach
from themeloom.sources.scan import cut_lineage, save_vectors

WORD = r"[\p{L}\p{N}]+"
NUMBER = r"^\p{N}+$"
URL = r"(https?://|www\.)\S+"
MAX_TERMS = 1 << 18


def words_of(text: Column | str, drop_urls: bool = False) -> Column:
    """Array of lower-case words of a text."""
    source = F.col(text) if isinstance(text, str) else text
    if drop_urls:
        source = F.regexp_replace(source, URL, " ")
    return F.regexp_extract_all(F.lower(source), F.lit(WORD), F.lit(0))


def split_words(df: DataFrame, id: str, text: str, drop_urls: bool = False) -> DataFrame:
    """Rows (id, words): each text as the array of its words.

    Store the rows before exploding them, or the optimizer's test for empty arrays splits the texts a
    second time.
    """
    return df.select(id, words_of(text, drop_urls).alias("words"))


def word_counts(words: Column) -> Column:
    """Array of (word, n) of an array of words: sorted, equal neighbours are a run, and a run has a length."""
    ordered = F.array_sort(words)

    def runs(ordered: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, first)
        return F.transform(
            F.array(starts),
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("word"),
                    (F.coalesce(F.get(s, k + 1), F.size(ordered)) - at).cast("long").alias("n"),
                ),
            ),
        )[0]

    # Bound to a lambda's argument, the sorted array is made once.
    return F.transform(F.array(ordered), runs)[0]


def counted_words(
    df: DataFrame,
    id: str,
    text: str,
    drop_urls: bool = False,
    stopwords: Sequence[str] | DataFrame = (),
    drop_numbers: bool = False,
    total: str | None = None,
) -> DataFrame:
    """Rows (id, word, n) of texts whose ids are unique, without any shuffle: a text is one row.

    stopwords: a list, or a table with a column `word` whose size does not grow with the data. total adds
    the number of words of the text, all words counted.
    """
    words = df.select(id, words_of(text, drop_urls).alias("_words"))
    extra = [F.size("_words").cast("long").alias(total)] if total else []
    rows = words.select(id, *extra, F.explode(word_counts(F.col("_words"))).alias("_w"))
    rows = rows.select(id, "_w.word", "_w.n", *([total] if total else []))
    if isinstance(stopwords, DataFrame):
        rows = rows.join(F.broadcast(stopwords.select("word").distinct()), "word", "left_anti").select(*rows.columns)
        stopwords = ()
    return rows.where(is_term(F.col("word"), stopwords, drop_numbers))


def explode_words(split: DataFrame, id: str = "id") -> DataFrame:
    return split.select(id, F.explode("words").alias("word"))


def tokenize(df: DataFrame, id: str, text: str, drop_urls: bool = False) -> DataFrame:
    """One row per word."""
    return df.select(id, F.explode(words_of(text, drop_urls)).alias("word"))


def is_term(word: Column, stopwords: Sequence[str], drop_numbers: bool) -> Column:
    keep = ~word.isin(list(stopwords)) if stopwords else F.lit(True)
    return keep & ~word.rlike(NUMBER) if drop_numbers else keep


def doc_term_counts(
    tokens: DataFrame, id: str = "id", stopwords: Sequence[str] = (), drop_numbers: bool = True
) -> DataFrame:
    """Sparse document-term matrix as rows (id, word, n)."""
    terms = tokens.where(is_term(F.col("word"), stopwords, drop_numbers))
    return terms.groupBy(id, "word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(
    dtm: DataFrame, n_docs: Column, min_prop: float = 0.001, max_prop: float = 0.999
) -> DataFrame:
    """Terms (word, df) found in a share of documents within the bounds."""
    low, high = (F.lit(Decimal(str(p))) * n_docs for p in (min_prop, max_prop))
    return (
        dtm.groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"))
        .where((F.col("df") >= low) & (F.col("df") <= high))
    )


def trim_vocabulary(dtm: DataFrame, n_docs: Column, min_prop: float = 0.001, max_prop: float = 0.999) -> DataFrame:
    """Rows of the matrix whose term is neither too rare nor too common."""
    kept = vocabulary(dtm, n_docs, min_prop, max_prop).select("word")
    return attach(dtm, kept, ["word"], "left_semi")


def tf_idf(
    dtm: DataFrame,
    id: str = "id",
    total: str | None = None,
    own: DataFrame | None = None,
    per_word: Mapping[str, Column] | None = None,
) -> DataFrame:
    """tf = n / words of the document, idf = ln(documents with words / documents with the word).

    total: the column with the number of words, which saves a shuffle by id. own: the part of the matrix that gets
    rows, whole documents, while frequencies count all of `dtm`; only that part is stored and joined then. per_word:
    more columns made of `word`, once for each word instead of each row. The rows are stored, as document frequencies
    and the join read them again.
    """
    # A window partition is one document.
    whole = F.col(total) if total else F.sum("n").over(Window.partitionBy(id))
    shares = cut_lineage((dtm if own is None else own).select(id, "word", "n", (F.col("n") / whole).alias("tf")))
    if own is None:
        n_docs = documents_with_words(shares, id)
        spread = cut_lineage(shares.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    else:
        spread, n_docs = document_frequencies(dtm, id)
    extra = dict(per_word or {})
    return (
        attach(shares, spread.withColumns(extra), ["word"], "inner", key_counts=spread.withColumnRenamed("df", "_rows"))
        .withColumn("idf", F.log(n_docs / F.col("df")))
        .select(id, "word", "n", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"), *extra)
    )


def document_frequencies(dtm: DataFrame, id: str = "id") -> tuple[DataFrame, Column]:
    """Stored rows (word, df) and the number of documents, from one pass over a matrix that is not stored."""
    counted = dtm.groupingSets([["word"], [id]], "word", id).agg(
        F.count(F.lit(1)).alias("df"), F.grouping("word").alias("_whole")
    )
    stored = cut_lineage(counted)
    return stored.where("_whole = 0").select("word", "df"), stored.where("_whole = 1").agg(F.count(id)).scalar()


def documents_with_words(dtm: DataFrame, id: str = "id") -> Column:
    """The number of documents of a matrix, the N of every idf here."""
    return dtm.agg(F.count_distinct(id)).scalar()


def term_list(terms: DataFrame, max_terms: int = MAX_TERMS) -> list[tuple]:
    """Vocabulary rows on the driver in word order; a vocabulary beyond the bound is an error, not cut."""
    rows = terms.limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"more than {max_terms} terms: raise min_prop")
    return sorted(tuple(r) for r in rows)


def doc_vectors(split: DataFrame, vocabulary: Sequence[str], id: str = "id", out: str = "features") -> DataFrame:
    """Sparse count vectors over a given vocabulary, with the number of words of the text.

    Takes the rows of split_words; there is no shuffle. A missing text counts as one without words. Store the
    result before `drop_empty`, or the vectors are made twice.
    """
    words = F.coalesce("words", F.array().cast("array<string>"))
    arrays = split.select(id, words.alias("words"), F.size(words).cast("long").alias("n_words"))
    model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="words", outputCol=out)
    return model.transform(arrays).drop("words")


def vector_counts(vectors: DataFrame, words: Sequence[str], id: str = "id", features: str = "features") -> DataFrame:
    """Matrix rows (id, word, n) of the sparse count vectors over a vocabulary."""
    parts = F.unwrap_udt(features)
    cells = vectors.select(id, F.inline(F.arrays_zip(parts["indices"].alias("_at"), parts["values"].alias("n"))))
    named = vectors.sparkSession.createDataFrame(list(enumerate(words)), "_at int, word string")
    # A vocabulary held on the driver has at most MAX_TERMS words.
    return attach(cells, named, ["_at"], "inner", bounded=True).select(id, "word", F.col("n").cast("long").alias("n"))


def drop_empty(vectors: DataFrame, features: str = "features") -> DataFrame:
    """Leave out texts without any vocabulary word."""
    return vectors.where(F.size(F.unwrap_udt(features)["indices"]) > 0)


def count_vectors(dtm: DataFrame, words: Sequence[str], id: str = "id", out: str = "features") -> DataFrame:
    """Sparse count vectors from matrix rows, for a part of the matrix such as a training part."""
    # One document per group.
    repeated = F.array_repeat("word", F.col("n").cast("int"))
    arrays = dtm.groupBy(id).agg(F.flatten(F.collect_list(repeated)).alias("_words"))
    model = CountVectorizerModel.from_vocabulary(list(words), inputCol="_words", outputCol=out)
    return model.transform(arrays).drop("_words")


def tfidf_vectors(
    split: DataFrame, terms: Sequence[tuple[str, int]], n_docs: int, id: str = "id", out: str = "features"
) -> DataFrame:
    """Sparse tf-idf vectors from a vocabulary with document frequencies, stored.

    A text without words has an empty vector. Vectors stay sparse however many words of the vocabulary a text has, so
    `drop_empty` keeps it.
    """
    counts = doc_vectors(split, [w for w, _ in terms], id, "_counts")
    idf = Vectors.dense([math.log(n_docs / spread) for _, spread in terms])
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="_counts", outputCol="_weighted").transform(counts)
    parts = F.unwrap_udt("_weighted")
    shares = parts.withField("values", F.transform(parts["values"], lambda x: x / F.col("n_words")))
    return save_vectors(weighted.select(id, "n_words", shares.alias(out)), {out: VectorUDT()})
