"""Topics fitted block by block, against one document at a time."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from themeloom.operators import topic_model, topics


def counted(docs=80, words=60, k=3, seed=5):
    rng = np.random.default_rng(seed)
    beta = rng.dirichlet(np.full(words, 0.2), k)
    return rng.poisson(rng.dirichlet(np.full(k, 0.4), docs) @ beta * rng.choice([3, 40, 900], docs)[:, None])


def flat(counts):
    return counts.nonzero()[1], counts[counts.nonzero()].astype(float), np.append(0, (counts > 0).sum(axis=1).cumsum())


@pytest.mark.parametrize("cells", [40, 1 << 14])
def test_blocks_settle_like_single_documents(monkeypatch, cells):
    monkeypatch.setattr(topic_model, "BLOCK_CELLS", cells)
    counts = counted()
    counts[7] = 0
    at, n, ends = flat(counts)
    rng = np.random.default_rng(1)
    rates, alpha, start = rng.dirichlet(np.ones(60), 3).T.copy(), np.array([0.2, 0.4, 0.9]), np.ones(3)
    found, norms = topic_model.settle(rates, alpha, start, at, n, ends)
    assert (found[7] == alpha).all()
    for i in set(range(80)) - {7}:
        e, c, now = rates[at[ends[i] : ends[i + 1]]], n[ends[i] : ends[i + 1]], start

        def turn(x, e=e, c=c):
            t = np.exp(topic_model.expected_logs(x))
            return t * (e.T @ (c / (e @ t))) + alpha

        while np.abs(turn(now) - now).max() > 1e-9:
            now = turn(now)
        if len(c):
            assert np.abs(turn(found[i]) - found[i]).mean() <= topic_model.SETTLED
            assert found[i] == pytest.approx(now, abs=0.02 * now.sum())
            assert norms[ends[i] : ends[i + 1]] == pytest.approx(e @ np.exp(topic_model.expected_logs(found[i])))


def test_fit_is_the_same_however_rows_are_dealt(spark):
    counts = counted()
    rows = [(i, Vectors.sparse(60, np.flatnonzero(c).tolist(), c[c > 0].tolist())) for i, c in enumerate(counts) if c.any()]
    vectors = spark.createDataFrame(rows, ["id", "features"])
    one, many = (topics.fit_topics(vectors.repartition(p), 3, max_iter=3) for p in (1, 7))
    shares = lambda m: {(r.topic, r.word): r.p for r in topics.model_beta(m, [f"w{i}" for i in range(60)]).collect()}
    assert shares(one) == pytest.approx(shares(many), rel=1e-9)
    theta = [{(r.id, r.topic): r.p for r in topics.model_theta(m, vectors).collect()} for m in (one, many)]
    assert theta[0] == pytest.approx(theta[1], rel=1e-6)


def test_bound_is_below_the_likelihood_of_one_topic(spark):
    # With one topic nothing is left to settle: the bound is that of a Dirichlet-multinomial around its mean.
    vectors = spark.createDataFrame([(1, Vectors.sparse(2, [0, 1], [3.0, 1.0]))], ["id", "features"])
    model = topic_model.TopicModel(spark, np.array([[4.0, 2.0]]), np.array([1.0]), 1.0, 1)
    inferred = model.infer(vectors)
    row = inferred.first()
    digamma = lambda whole: sum(1 / i for i in range(1, whole)) - 0.5772156649015329
    logs = [digamma(4) - digamma(6), digamma(2) - digamma(6)]
    assert row.shares == [1.0] and row.bound == pytest.approx(3 * logs[0] + logs[1])
    words = -3 * logs[0] - logs[1] + math.lgamma(4) + math.lgamma(2) + math.lgamma(2) - math.lgamma(6)
    assert model.bound(inferred) == pytest.approx(row.bound + words)


def test_words_counted_by_vectors_are_the_trimmed_ones(spark, tmp_path):
    from themeloom.operators import text
    from themeloom.plans import catalog, texts

    rows = [(i, f"common w{i % 5} w{i % 5} rare{i}") for i in range(300)] + [(3, "w1 w2"), (None, "w1 w1"), (9, None), (10, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    split = catalog.stored_words(spark, str(tmp_path)).where("size(words) > 0")
    words = [w for w, _ in texts._vocabulary(spark, str(tmp_path), split)]
    listed = lambda df: sorted(map(str, df.select("id", "word", "n").collect()))
    found = text.vector_counts(text.doc_vectors(split, words), words)
    assert listed(found) == listed(catalog.trimmed_counts(spark, str(tmp_path)))
    assert {r.word for r in found.collect()} == {"common", "w0", "w1", "w2", "w3", "w4"}


def test_sweep_asks_for_all_passes(spark, tmp_path, monkeypatch):
    from themeloom.plans import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{w}" for w in rng.choice(30, 40) + 20 * (i % 3))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fit, asked = topics.fit_topics, []

    def one_pass(vectors, k, seed, max_iter):
        asked.append((k, max_iter))
        return fit(vectors, k, seed, 1)

    monkeypatch.setattr(topics, "fit_topics", one_pass)
    found = {(r.k, r.metric): r.value for r in QUERIES["topic_k_metrics"](spark, str(tmp_path)).collect()}
    assert asked == [(4, 50), (8, 50)]
    assert len(found) == 12 and found[4, "iterations"] == found[8, "iterations"] == 50
