"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one for each shard.

Building a shard: greedy searches in the graph so far propose neighbours for each point, relaxed distance
pruning keeps diverse ones (a candidate goes if a kept one is nearer to it, times alpha, than the point
is), and the edges are laid in both directions. Inner products become distances by one more coordinate
that brings all vectors to the same length. A query walks each shard with a beam, and what it finds is
scored on the original vectors in double precision.

Equal vectors are one point of the graph with its smallest ids, as many as a result can need, so copies
neither crowd out a beam nor get lost.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, finite_vector, main_dimension, query, table

SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 96
ALPHAS = (1.0, 1.2)
BATCH = 512
SEED = 5


def augmented(X: np.ndarray) -> np.ndarray:
    """One more coordinate so that all rows have the same length: the nearest row has the largest product."""
    squares = (X.astype(np.float64) ** 2).sum(1)
    return np.concatenate([X, np.sqrt(np.maximum(0, squares.max(initial=0) - squares))[:, None]], 1).astype(np.float32)


def beam_search(graph: np.ndarray, X: np.ndarray, Q: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points each query meets (-1: none), nearest first, and their distances but for |q|^2.

    All queries take a step at a time: each opens its nearest point that is not open yet.
    """
    n, b = len(X), len(Q)
    squares = (X**2).sum(1)
    rows = np.arange(b)
    ids = np.full((b, beam), -1, np.int64)
    away = np.full((b, beam), np.inf, np.float32)
    opened = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # where missing edges point
    ids[:, 0], away[:, 0] = entry, squares[entry] - 2 * Q @ X[entry]
    seen[:, entry] = True
    active = rows
    while len(active):
        waiting = np.where(opened[active] | (ids[active] < 0), np.inf, away[active])
        nearest = waiting.argmin(1)
        open_ = np.isfinite(waiting[np.arange(len(active)), nearest])
        active, nearest = active[open_], nearest[open_]
        if not len(active):
            break
        opened[active, nearest] = True
        around = graph[ids[active, nearest]]
        fresh = ~seen[active[:, None], around]
        seen[active[:, None], around] = True
        distance = squares[np.minimum(around, n - 1)] - 2 * np.einsum("brd,bd->br", X[np.minimum(around, n - 1)], Q[active])
        distance[~fresh] = np.inf
        all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], 1)
        all_away = np.concatenate([away[active], distance], 1)
        all_open = np.concatenate([opened[active], np.zeros_like(fresh)], 1)
        order = np.argsort(all_away, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(active))[:, None]
        ids[active], away[active], opened[active] = all_ids[at, order], all_away[at, order], all_open[at, order]
    return np.where(np.isfinite(away), ids, -1), away


def robust_prune(X: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point at most `degree` of its candidates (-1 or len(X): none) that are near and diverse."""
    n = len(X)
    bad = (candidates < 0) | (candidates >= n) | (candidates == points[:, None])
    c = np.where(bad, 0, candidates)
    away = ((X[c] - X[points][:, None, :]) ** 2).sum(2)
    away[bad] = np.inf
    # The same candidate twice counts once.
    order = np.lexsort((candidates, away), axis=1)
    at = np.arange(len(points))[:, None]
    c, away = c[at, order], away[at, order]
    away[:, 1:][(c[:, 1:] == c[:, :-1]) & np.isfinite(away[:, 1:])] = np.inf
    vectors = X[c]
    alive = np.isfinite(away)
    kept = np.full((len(points), degree), n, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = np.where(alive, away, np.inf).argmin(1)
        kept[some, k] = c[rows[some], first[some]]
        chosen = vectors[rows, first]
        apart = ((vectors - chosen[:, None, :]) ** 2).sum(2)
        alive &= alpha * alpha * apart > away
        alive[rows, first] = False
    return kept


def build_graph(X: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = SEED) -> tuple[np.ndarray, int]:
    """Out-edges of each point (len(X): none) and the entry, the point nearest to the mean."""
    n = len(X)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), n, np.int64)
    if n > 1:
        graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    entry = int(((X - X.mean(0)) ** 2).sum(1).argmin())
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            points = order[i : i + BATCH]
            met, _ = beam_search(graph, X, X[points], entry, beam)
            graph[points] = robust_prune(X, points, np.concatenate([met, graph[points]], 1), degree, alpha)
            _add_back_edges(graph, X, points, degree, alpha)
    return graph, entry


def _add_back_edges(graph: np.ndarray, X: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    n = len(X)
    ends = graph[points]
    sources = np.repeat(points, degree)[ends.ravel() < n]
    targets = ends.ravel()[ends.ravel() < n]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    uniq, start, count = np.unique(targets, return_index=True, return_counts=True)
    place = np.arange(len(targets)) - np.repeat(start, count)
    # Points with many new edges take them in several turns.
    for turn in range(0, int(count.max(initial=0)), degree):
        now = (place >= turn) & (place < turn + degree)
        who = uniq[count > turn]
        extra = np.full((len(who), degree), n, np.int64)
        extra[np.searchsorted(who, targets[now]), place[now] - turn] = sources[now]
        for j in range(0, len(who), BATCH):
            some = who[j : j + BATCH]
            both = np.concatenate([graph[some], extra[j : j + BATCH]], 1)
            free = (both < n).sum(1)
            full = free > degree
            # Room left: the new edges are simply added, each once.
            simple = np.sort(np.where((extra[j : j + BATCH, :, None] == graph[some][:, None, :]).any(2), n, extra[j : j + BATCH]), 1)
            joined = np.sort(np.concatenate([graph[some], simple], 1), 1)[:, :degree]
            graph[some[~full]] = joined[~full]
            if full.any():
                graph[some[full]] = robust_prune(X, some[full], both[full], degree, alpha)


def build_index(vectors: DataFrame, most_ids: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row for each shard with its vectors, ids and graph, and the number of shards.

    vectors: vec_id, v (array<double>), of one dimension. Every vector is in the index. Equal vectors are
    one point that keeps its most_ids smallest ids; that many per vector leave each task, so a vector that a
    third of all rows share does not gather anywhere. A shard is bounded and chosen by hash.
    """
    stages = Stages(vectors.sparkSession)
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_ids)
    points = stages.keep(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n_shards = max(1, ceil(points.count() / shard_rows))
    sharded = points.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n_shards)).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[x[0] for x in frame["ids"]]).sort_values("first")
        X = np.stack(frame["v"].to_numpy()).astype(np.float64)
        graph, entry = build_graph(augmented(X))
        counts = frame["ids"].map(len).to_numpy(np.int32)
        return pd.DataFrame(
            {
                "shard": [int(frame["shard"].iloc[0])],
                "n": [len(frame)],
                "entry": [entry],
                "vectors": [X.tobytes()],
                "graph": [graph.astype(np.int32).tobytes()],
                "counts": [counts.tobytes()],
                "ids": [np.concatenate(frame["ids"].to_numpy()).astype(np.int64).tobytes()],
            }
        )

    schema = "shard int, n int, entry int, vectors binary, graph binary, counts binary, ids binary"
    # Four partitions for each shard, so that few tasks get two and none are merged.
    dealt = sharded.repartition(4 * n_shards, "shard")
    index = stages.keep(dealt.groupBy("shard").applyInPandas(build, schema))
    stages.drop(points)
    return index, n_shards


def search_shard(shard: pd.Series, queries: np.ndarray, own: np.ndarray, k: int, beam: int) -> pd.DataFrame:
    """query_id, vec_id, score of the k best that each query finds in a shard."""
    n = int(shard["n"])
    X = np.frombuffer(shard["vectors"]).reshape(n, -1)
    graph = np.frombuffer(shard["graph"], np.int32).reshape(n, -1).astype(np.int64)
    counts, ids = np.frombuffer(shard["counts"], np.int32), np.frombuffer(shard["ids"], np.int64)
    starts = np.cumsum(counts) - counts
    A = augmented(X)
    out = []
    for i in range(0, len(queries), BATCH):
        q = queries[i : i + BATCH]
        asked = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        met, _ = beam_search(graph, A, asked, int(shard["entry"]), max(beam, k + 1))
        row, at = np.nonzero(met >= 0)
        point = met[row, at]
        score = (X[point] * q[row]).sum(1)
        each = counts[point]
        total = np.repeat(np.arange(len(row)), each)
        vec = ids[np.repeat(starts[point], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        frame = pd.DataFrame({"row": row[total], "query_id": own[i : i + BATCH][row[total]], "vec_id": vec, "score": score[total]})
        frame = frame[frame["vec_id"] != frame["query_id"]].sort_values(["row", "score", "vec_id"], ascending=[True, False, True])
        out.append(frame.groupby("row").head(k)[["query_id", "vec_id", "score"]])
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, beam: int = SEARCH_BEAM
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors found with the largest inner product.

    Both tables have vec_id and v (array<double>). Null ids and vectors take no part, nor do those of
    another dimension than most; a query's own id is left out, ties go to smaller ids, all candidates come
    if there are fewer than k (and the beam is not smaller), empty tables give no rows. Of queries that
    repeat an id the least vector counts. A task holds one shard and one block of queries, both bounded.
    """
    dim = main_dimension(vectors.where("v IS NOT NULL"), "v")
    usable = F.col("vec_id").isNotNull() & (F.size("v") == dim)
    if dim == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, n_shards = build_index(vectors.where(usable).select("vec_id", "v"), k + 1, shard_rows)
    asked = queries.where(usable).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, ceil(asked.count() / block_rows))
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    each = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def walk(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return search_shard(x.iloc[0], np.stack(q["v"].to_numpy()).astype(float), q["vec_id"].to_numpy(np.int64), k, beam)

    pairs = each.groupBy("shard", "block").cogroup(held.groupBy("shard", "block"))
    found = pairs.applyInPandas(walk, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op2_ann")
def op2(spark, sf):
    rows = table(spark, sf, "embeddings").where(finite_vector("embedding"))
    zero = ~F.exists("embedding", lambda x: x != 0)
    vectors = rows.where(~zero).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
