"""Targets, sums and draws of the mix against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest

from themeloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted([k for k in sizes if k is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [k for k in names if k not in full]
        if not rest:
            break
        level = (total - sum(most * sizes[k] for k in full)) / sum(w[k] for k in rest)
        over = {k for k in rest if level * w[k] >= most * sizes[k]}
        if not over:
            break
        full |= over
    return {k: most * sizes[k] if k in full else level * w[k] for k in names}


def check(rows, texts):
    """rows: of mix; texts: (id, source, text)."""
    sizes = {}
    for _, s, t in texts:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    wanted, taken = targets(sizes), dict.fromkeys(sizes, 0)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]], rel=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] == r["times"] * r["size"]
        taken[r["source"]] += r["taken"]
    return wanted, taken


def test_whole_table_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    texts = [tuple(r) for r in docs.collect()]
    rows = mixing.mix(docs).collect()
    wanted, taken = check(rows, texts)
    # Near the ends of the possible sums the smallest document is the smallest step.
    least = {s: min(len(WORD.findall(t)) for _, q, t in texts if q == s) for s in wanted}
    assert all(abs(taken[s] - wanted[s]) <= least[s] for s in wanted)
    assert sum(abs(taken[s] - wanted[s]) <= 0.5 for s in wanted) >= len(wanted) - 2
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_odd_rows(spark):
    texts = [(1, "b", "one two"), (2, None, "a b c"), (3, "", "x"), (4, "a", None), (5, "B", ""), (None, "b", "q " * 3000),
             (7, "é", " one two three"), (8, "é", "z " * 40_000), (9, "b", "same"), (9, "b", "same"), (9, "b", "same")]
    docs = spark.createDataFrame([(*t, "mine") for t in texts], "doc_id long, source string, text string, size string")
    rows = mixing.mix(docs).withColumnsRenamed({"size": "mine", "_size": "size"}).collect()
    check(rows, texts)
    assert {r["mine"] for r in rows} == {"mine"}
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = mixing.mix(docs.where("doc_id = 4")).collect()
    assert [(r["_size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)]


def test_equal_rows_of_one_source_and_length(spark):
    texts = [(1, "a", "w x y")] * 900 + [(i, "b", "w x") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    wanted, taken = check(mixing.mix(docs).collect(), texts)
    assert all(abs(taken[s] - wanted[s]) <= 3 for s in wanted)
    drawn = lambda seed: sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs, seed=seed).collect())
    # b takes each document once and some twice; the seed says which.
    first, again, other = drawn(1), drawn(1), drawn(2)
    assert first == again != other
    assert sum(t for _, t in first) == sum(t for _, t in other)


@pytest.mark.parametrize("seed", range(40))
def test_fit_reaches_the_nearest_sum(seed):
    rng = random.Random(seed)
    lengths = np.array(rng.sample(range(1, 40), rng.randint(1, 5)), dtype=np.int64)
    counts = np.array([rng.randint(1, 4) for _ in lengths], dtype=np.int64)
    budget = rng.uniform(0, float((lengths * counts).sum()))
    left = mixing._knapsack(lengths, counts, max(1, round(budget)))
    assert (left <= counts).all() and (left >= 0).all()
    sums = {sum(a * b for a, b in zip(lengths.tolist(), c, strict=True)) for c in itertools.product(*[range(n + 1) for n in counts])}
    goal = max(1, round(budget))
    assert abs(int((left * lengths).sum()) - goal) == min(abs(s - goal) for s in sums)
    whole = mixing.fit(lengths, counts, budget, dp_budget=10_000)
    assert (whole <= counts).all() and abs(int((whole * lengths).sum()) - budget) <= lengths.max()


def test_fit_with_large_budgets_stays_near():
    rng = np.random.default_rng(0)
    lengths = np.arange(1, 3000, dtype=np.int64)
    counts = rng.integers(1, 500, len(lengths))
    for part in (0.01, 0.5, 0.77, 1.0):
        budget = part * int((lengths * counts).sum())
        taken = mixing.fit(lengths, counts, budget)
        assert (taken <= counts).all() and abs(int((taken * lengths).sum()) - budget) <= 1
