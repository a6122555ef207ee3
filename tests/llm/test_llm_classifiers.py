"""Classifiers by held-out accuracy, and their parts by hand."""

import numpy as np
import pytest

from themeloom.llm import QUERIES, quality, toxicity


def with_truth(spark, name, label, sf="/root/testdata/sf0.1"):
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return QUERIES[name](spark, sf).join(truth, "doc_id").where(f"held_out AND {label} IS NOT NULL").toPandas()


def test_quality_on_held_out_rows(spark):
    rows = with_truth(spark, "op7_quality", "quality")
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert good["predicted"].mean() >= 0.95 and bad["predicted"].mean() <= 0.1


def test_toxicity_on_held_out_rows(spark):
    rows = with_truth(spark, "op9_toxicity", "toxic")
    clean, toxic = rows[rows["toxic"] == 0], rows[rows["toxic"] == 1]
    assert clean["predicted"].mean() <= 0.01 and toxic["predicted"].mean() >= 0.78
    assert (toxic["score"].to_numpy()[:, None] > clean["score"].to_numpy()[None, :]).mean() >= 0.9


def test_unseen_misspellings_score_like_the_word():
    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ri", "su", "to") for c in ("va", "we", "xi", "yo")]
    texts, labels = [], []
    for i in range(600):
        text = rng.choice(words, 40).tolist()
        if i % 3 == 0:
            text[int(rng.integers(40))] = str(rng.choice(["horrendous", "blockhead"]))
        texts.append(" ".join(text))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels, (2 / 3, 1 / 3))
    scores = model.word_scores(["horrendus", "horendous", "blokhead", "karisuva", "lotowe"])
    assert scores[:3].min() > scores[3:].max()


def by_hand(text, model):
    """The score of a text in plain Python: n-grams, words, windows, curve."""
    means = []
    for w in toxicity.WORDS.findall((text or "").lower()):
        marked, total, count = f"<{w}>", 0.0, 0
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                h = ((h ^ n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % len(model.scores)
                total, count = total + float(model.scores[h]), count + 1
        means.append(total / count)
    k = min(model.window, len(means))
    worst = max((sum(means[i : i + k]) / k for i in range(len(means) - k + 1)), default=0.0) if k else 0.0
    logit = worst + model.bias
    curve = 1 / (1 + np.exp(-(model.slope * logit + model.shift)))
    xs, ps = model.steps
    at = int(np.searchsorted(xs, logit))
    share = ps[0] if at == 0 else ps[-1] if at == len(xs) else ps[at - 1] + (ps[at] - ps[at - 1]) * (logit - xs[at - 1]) / (xs[at] - xs[at - 1])
    return (1 - toxicity.CURVE) * share + toxicity.CURVE * curve


def test_whole_scores_by_hand(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["sun", "moon", "sea", "å!", "foul", "tree"], 12)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "x", "foul foul", "sun " * 300 + "fool"])]
    labels = [(i, int("foul" in t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == pytest.approx(by_hand(t, model), abs=1e-6) for i, t in rows)


def test_steps_rise():
    logits, y = np.array([0.0, 1.0, 1.0, 2.0, 3.0, 3.0]), np.array([0, 0, 1, 0, 1, 1])
    xs, ps = toxicity.risen_shares(logits, y, (0.5, 0.5))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) > 0).all()
    assert toxicity.risen_shares(logits, np.zeros(6, int), (1.0, 0.0)) is None


def test_grams_belong_to_their_words():
    at, found = toxicity.grams(["ab", "ab", "x", "longer"])
    assert set(at.tolist()) == {0, 1, 2, 3}
    assert found[at == 0].tolist() == found[at == 1].tolist() and len(found[at == 2]) == 1
    assert toxicity.grams([])[0].size == 0


def docs(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "!!! ", "s"), (4, "word " * 50_000, "s"), (None, "a text", "s"), (5, "same", "s"), (5, "same", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.mark.parametrize("labels", [[], [(5, 1)], [(5, 1), (5, 0), (None, 1), (4, None), (9, 1)], [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)]])
def test_odd_rows_and_labels(spark, labels):
    toxic = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs(spark), toxicity.train(docs(spark), toxic)).collect()
    assert len(out) == 7 and all(0 <= r["_score"] <= 1 and r["score"] == "s" for r in out)
    graded = quality.score_quality(docs(spark), toxic.withColumnRenamed("toxic", "quality")).collect()
    assert len(graded) == 7 and all(0 <= r["_score"] <= 1 and r["score"] == "s" for r in graded)
    empty = docs(spark).limit(0)
    assert toxicity.score(empty, toxicity.train(empty, toxic)).collect() == []
    assert quality.score_quality(empty, toxic.withColumnRenamed("toxic", "quality")).collect() == []


def test_normal_equations_equal_one_product(spark):
    rng = np.random.default_rng(2)
    X, y = rng.normal(size=(500, len(quality.STATISTICS))), rng.integers(0, 2, 500)
    kernel = quality.Kernel.drawn(X.mean(0), X.std(0), 16, 1.0, 1)
    rows = [(x.tolist(), int(v), i % 3) for i, (x, v) in enumerate(zip(X, y, strict=True))]
    frame = spark.createDataFrame(rows, "statistics array<double>, y int, fold int").repartition(40)
    sums = quality.normal_equations(frame, kernel, 3).sum(0)
    Z = kernel(X)
    assert np.allclose(sums[:, :17], Z.T @ Z) and np.allclose(sums[:, 17], Z.T @ y) and sums[0, 18] == 500


def test_isotonic_pools_violators():
    x, p = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.ones(4) * 100, np.array([10.0, 50.0, 30.0, 90.0]))
    assert x.tolist() == [0.0, 1.5, 3.0] and np.allclose(p, [10.5 / 101, 80.5 / 201, 90.5 / 101])


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(30, 4))
    kernel = quality.Kernel.drawn(np.zeros(4), np.ones(4), 20_000, 1.0, 3)
    Z = kernel(X)[:, :-1]
    exact = np.exp(-((X[:, None] - X[None]) ** 2).sum(2) / (2 * 4))
    assert np.abs(Z @ Z.T - exact).max() < 0.05
