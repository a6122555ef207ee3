"""Exact and approximate search against brute force."""

import numpy as np
import pytest

from themeloom.llm import QUERIES, ann, topk

SF = "/root/testdata/sf0.01"


def brute(ids, X, asked, k):
    out = {}
    for i in asked:
        scores = X @ X[i]
        rows = sorted((-s, v) for s, v in zip(scores.tolist(), ids, strict=True) if v != ids[i])[:k]
        out[ids[i]] = [(v, -s) for s, v in rows]
    return out


def got(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("scale", ["same", "wide", "tied", "clustered"])
def test_top_k_equals_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    X = rng.integers(-50, 50, (600, 8))
    if scale == "wide":
        X = X * rng.integers(1, 200, (600, 1))
    if scale == "tied":
        X = rng.integers(0, 2, (600, 8))
    if scale == "clustered":
        X = np.repeat(rng.integers(-500, 500, (12, 8)), 50, axis=0) + rng.integers(-2, 3, (600, 8))
    ids = (np.arange(600) * 3).tolist()
    df = spark.createDataFrame(list(zip(ids, X.tolist(), strict=True)), "vec_id long, v array<long>").repartition(4)
    asked = [i for i in range(600) if ids[i] % 10 == 0]
    rows = topk.top_k(df, df.where("vec_id % 10 = 0"), 5, bucket_rows=64, block_rows=16).collect()
    assert got(rows) == brute(ids, X, asked, 5)


def test_top_k_large_numbers_and_odd_rows(spark):
    rows = [(0, [2**40, 1]), (1, [2**20, 2**20]), (2, [1, 1]), (None, [1, 1]), (3, None), (4, [1, 2, 3]), (0, [2**40, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    out = topk.top_k(df, df.where("vec_id = 0"), 5).collect()
    assert got(out) == {0: [(1, 2**60 + 2**20), (2, 2**40 + 1)]}
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []


@pytest.mark.parametrize("low", [27, 28, 29])
def test_scores_beyond_double_precision(spark, low):
    rng = np.random.default_rng(low)
    X = rng.integers(2**low - 1000, 2**low + 1000, (40, 8)) * rng.choice([-1, 1], (40, 8))
    X[:3, 1:] = 0
    X[0, 0], X[1, 0] = 2**low + 1, 2**low + 3
    ids = list(range(40))
    df = spark.createDataFrame(list(zip(ids, X.tolist(), strict=True)), "vec_id long, v array<long>")
    rows = topk.top_k(df, df, 5, bucket_rows=16, block_rows=8).collect()
    assert got(rows) == brute(ids, X, ids, 5)
    assert any(abs(s) > 2**53 and s % 2 for hits in got(rows).values() for _, s in hits)


def test_products_are_exact_up_to_63_bits():
    wide = np.full((1, 64), 2**28, dtype=np.int64)
    wide[0, 0] = 2**29 + 1
    assert topk.products(wide, wide)[0, 0] == sum(x * x for x in wide[0].tolist())
    ones = np.ones((1, 3), dtype=np.int64)
    assert topk.products(np.array([[2**62, 2**62 - 1, 0]]), ones)[0, 0] == 2**63 - 1
    assert topk.products(np.array([[2**62, 2**62, -7]]), ones)[0, 0] == 2**63 - 7
    assert topk.products(np.array([[-(2**62), -(2**62), 0]]), ones)[0, 0] == -(2**63)
    topk.check_fit(ones[0], np.array([[2**62, 2**62 - 1, 0], [-(2**62), -(2**62), 0]]))
    with pytest.raises(OverflowError):
        topk.check_fit(ones[0], np.array([[2**62, 2**62, 0]]))


def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r["vec_id"] for r in rows]
    X = np.array([r["embedding"] for r in rows], float)
    exact = brute(ids, X, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    found = got(QUERIES["op2_ann"](spark, SF).collect())
    assert found.keys() == exact.keys()
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in exact[q]}) for q in exact)
    assert hits >= 0.95 * 20 * len(exact)
    for q, held in found.items():
        assert [s for _, s in held] == sorted((s for _, s in held), reverse=True)
        assert np.allclose([s for _, s in held], [X[ids.index(v)] @ X[ids.index(q)] for v, _ in held], rtol=0, atol=1e-12)


def test_several_shards_norms_and_copies(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    X[1000:1600] = X[7]
    ids = list(range(3000))
    df = spark.createDataFrame(list(zip(ids, X.tolist(), strict=True)), "vec_id long, v array<double>")
    rows = ann.nearest(df, df.where("vec_id % 20 = 0"), 10, shard_rows=700, block_rows=64).collect()
    exact = brute(ids, X, range(0, 3000, 20), 10)
    found = got(rows)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in exact[q]}) for q in exact)
    assert hits >= 0.95 * 10 * len(exact)
    # Among equal vectors the smallest ids come, the query's own left out.
    assert [v for v, _ in found[1000] if v in {7, *range(1000, 1600)}][:5] == [v for v, _ in exact[1000] if v in {7, *range(1000, 1600)}][:5]


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    out = got(ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect())
    assert out == {0: [(20, 0.5), (3, 0.0)], 20: [(0, 0.5), (3, 0.5)]}
    assert ann.nearest(df.limit(0), df.limit(0), 20).collect() == []


def test_pruning_keeps_near_and_diverse_points():
    X = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    kept = ann.robust_prune(X, np.array([0]), np.array([[1, 2, 3, 4, 4, -1, 0]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, 5]]


def test_null_components_take_no_part(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (50, [float("nan"), 1.0]), (100, [1.0, None]), (1, [0.5, 0.25]), (2, [float("inf"), 0.0]), (3, []), (4, None), (20, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    exact = got(QUERIES["op6_exact_topk"](spark, str(tmp_path)).collect())
    assert exact == {0: [(1, 256 * 128), (20, 0)]}
    near = got(QUERIES["op2_ann"](spark, str(tmp_path)).collect())
    assert near == {0: [(1, 0.5)]}
