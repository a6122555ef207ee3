"""Words in cells beside numbers, against plain Python."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import models, text, word_features

TEXTS = [(1, "Sun sun and wind"), (2, "wind"), (3, ""), (4, None), (5, "sea, wind, sun; and waves"), (6, "a" * 5000)]
CELLS = 8


def expected():
    counts = {i: Counter(w.lower() for w in (t or "").replace(",", " ").replace(";", " ").split()) for i, t in TEXTS}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    cells = defaultdict(float)
    for i, c in counts.items():
        for w, n in c.items():
            digest = int(hashlib.md5(f"{word_features.SEED}|{w}".encode()).hexdigest()[:8], 16) % (2 * CELLS)
            cells[i, digest // 2] += (1 if digest % 2 == 0 else -1) * n / sum(c.values()) * math.log(len(counts) / df[w])
    return cells


@pytest.fixture(scope="module")
def matrix(spark):
    return text.counted_words(spark.createDataFrame(TEXTS, "id long, text string"), "id", "text", total="total")


def test_cells_are_signed_sums(matrix):
    rows = word_features.word_cells(text.tf_idf(matrix, total="total"), cells=CELLS).collect()
    assert {(r.id, r.cell): pytest.approx(r.value) for r in rows} == dict(expected())


def test_numbers_then_words_in_one_vector(spark, matrix):
    numbers = spark.createDataFrame([(1, 1, 0.5), (3, 0, 1.5), (99, 1, 2.5), (5, 0, 0.0), (5, 1, 3.0)], "id long, label int, v double")
    rows = word_features.assemble(numbers, matrix, ["v"], cells=CELLS).collect()
    assert len(rows) == 5
    for r in rows:
        words = {c: x for (i, c), x in expected().items() if i == r.id}
        assert np.allclose(r.x.toArray(), [r.v, *[words.get(c, 0.0) for c in range(CELLS)]])
    with pytest.raises(ValueError, match="already"):
        word_features.assemble(numbers.withColumnRenamed("v", "X"), matrix, ["X"], cells=CELLS)
    assert word_features.assemble(numbers.limit(0), matrix, ["v"], cells=CELLS).count() == 0


def test_penalties_and_classifiers_take_a_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    rows = [(i, int(a[0] + 0.3 * rng.normal() > 0), *map(float, a)) for i, a in enumerate(x)]
    plain = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    from pyspark.ml.functions import array_to_vector

    block = plain.withColumn("x", array_to_vector(F.array("a", "b", "c"))).persist()
    assert models.lambda_path(block, "label", ["x"], 1.0, 4) == pytest.approx(models.lambda_path(plain, "label", ["a", "b", "c"], 1.0, 4))
    scored = models.score(models.fit_classifier("lasso", block, "label", ["x"], points=3, folds=2), block, "label")
    assert scored.where((F.col("score") > 0.5) == (F.col("label") == 1)).count() > 340
    block.unpersist()


def test_only_the_words_of_the_rows_travel(spark, matrix, monkeypatch):
    """Texts without a row of numbers count in the frequencies; their words are neither stored nor joined."""
    kept, store = [], text.cut_lineage
    monkeypatch.setattr(text, "cut_lineage", lambda df: kept.append(store(df)) or kept[-1])
    numbers = spark.createDataFrame([(1, 0.5), (None, 1.0), (1, 2.0)], "id long, v double")
    own = matrix.where("id = 1")
    for part in (None, own):
        rows = word_features.assemble(numbers, matrix, ["v"], cells=CELLS, own=part).collect()
        assert sorted(r.v for r in rows) == [0.5, 1.0, 2.0]
        for r in rows:
            words = {c: x for (i, c), x in expected().items() if i == r.id}
            assert np.allclose(r.x.toArray(), [r.v, *[words.get(c, 0.0) for c in range(CELLS)]])
    stored = [df for df in kept if {"id", "tf"} <= set(df.columns)]
    assert stored and all({r.id for r in df.select("id").collect()} == {1} for df in stored)


def test_frequencies_from_one_pass(spark):
    dtm = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "b"), (3, None)], "id long, word string")
    spread, docs = text.document_frequencies(dtm)
    assert {(r.word, r.df) for r in spread.collect()} == {("a", 2), ("b", 2), (None, 1)}
    assert spark.range(1).select(docs.alias("n")).first().n == dtm.select(text.documents_with_words(dtm).alias("n")).first().n == 3


def test_vocabulary_counts_the_words_of_a_text_once_unsorted(spark, tmp_path, monkeypatch):
    from themeloom.plans import texts

    docs = spark.createDataFrame([(1, "b a A"), (2, "a"), (3, None), (4, ""), (4, "a")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    split = text.split_words(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    monkeypatch.setattr(text, "word_counts", lambda words: pytest.fail("sorts the words of every text"))
    assert texts._vocabulary(spark, str(tmp_path), split) == [("a", 3), ("b", 1)]
