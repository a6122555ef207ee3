"""Exact top-k inner products by buckets of similar norm.

Vectors are put in order of their norm and cut into buckets of bounded size. A first bucket of long
vectors gives each query a score that k vectors reach. For any other bucket that score, over the query's
norm and the bucket's largest, is the cosine a vector needs there: above 1 the bucket is left out before
anything moves, if it is high the vector's coordinates must lie close to the query's on the query's
largest coordinates, and else its norm must be large enough. What passes is verified by its product.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, finite_vector, main_dimension, query, table

BUCKET_ROWS = 4_096
BLOCK_ROWS = 1_024
FOCUS = 4
COORDINATE_FROM = 0.7  # cosine from which coordinates prune better than norms
EXACT = 2.0**53
LONG = 2.0**63


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T of whole numbers, exact: in double precision if every sum stays below 2^53.

    Beyond that in 64-bit integers, which are right whatever their parts are if the sum itself fits them.
    """
    a, b = left.astype(float), right.astype(float)
    if _largest(a, b) < EXACT:
        return (a @ b.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def _largest(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * a.shape[-1]


def check_fit(one: np.ndarray, others: np.ndarray) -> None:
    """Stops at an inner product that does not fit a long."""
    a, b = one.astype(float), others.astype(float)
    most = _largest(a, b)
    if most >= LONG / 2:
        for j in np.flatnonzero(np.abs(b @ a) >= LONG - np.spacing(most) * len(one)):
            score = sum(x * y for x, y in zip(one.tolist(), others[j].tolist(), strict=True))
            if not -(2**63) <= score < 2**63:
                raise OverflowError(f"the inner product {score} does not fit a long")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_bucket(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best for each query in one bucket, but none that its floor rules out."""
    vectors = vectors.sort_values("norm", ascending=False, kind="stable")
    Q, X = np.stack(queries["v"].to_numpy()), np.stack(vectors["v"].to_numpy())
    ids, floors = vectors["vec_id"].to_numpy(np.int64), queries["floor"].to_numpy(float)
    own = queries["vec_id"].to_numpy(np.int64)
    x_norm, q_norm = vectors["norm"].to_numpy(float), queries["norm"].to_numpy(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = floors / q_norm  # the norm a vector needs at cosine 1
        cosine = needed / x_norm.max() * (1 - 1e-9)
    cosine = np.where(np.isfinite(cosine), cosine, -1.0)
    out = []

    def take(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        other = ids[at] != own[i]
        at, scores = at[other], scores[other]
        check_fit(Q[i], X[at])
        out.extend((int(own[i]), int(ids[at[j]]), int(scores[j])) for j in best(scores, ids[at], k))

    by_coordinate = np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1))
    if len(by_coordinate):
        unit = X / np.where(x_norm > 0, x_norm, 1.0)[:, None]
        for i in by_coordinate:
            q, t = Q[i] / q_norm[i], cosine[i]
            passed = x_norm >= needed[i] * (1 - 1e-9)
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f]))) + 1e-9
                passed &= np.abs(unit[:, f] - q[f] * t) <= reach + abs(q[f]) * (1 - t)
            at = np.flatnonzero(passed)
            if len(at):
                take(i, at, products(Q[i : i + 1], X[at])[0])
    # Vectors stand by falling norm: a query multiplies those up to the first that is too short for it.
    rest = np.flatnonzero(cosine < COORDINATE_FROM)
    least = np.where(floors > 0, needed, -1.0) * (1 - 1e-9)
    reach = np.searchsorted(-x_norm, -least, side="right")
    rest = rest[np.argsort(reach[rest], kind="stable")]
    for j in range(0, len(rest), 128):
        some = rest[j : j + 128]
        scores = products(Q[some], X[: reach[some].max()])
        for i, row in zip(some, scores, strict=True):
            at = np.arange(reach[i])
            take(i, at, row[at])
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of the largest inner product, but its own.

    Both tables have vec_id and v (array<long>); of queries that repeat an id the least vector counts. Null ids and vectors take no part, and neither do those
    of another dimension than most; an id that repeats is never its own partner. Ties go to smaller ids,
    all candidates come if there are fewer than k, empty tables give no rows. A score that does not fit a long
    stops the job.

    A task holds a bucket and a block of queries, both bounded; equal vectors spread over buckets.
    """
    stages = Stages(vectors.sparkSession)
    dim = main_dimension(vectors.where("v IS NOT NULL"), "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    usable = lambda df: df.where(F.col("vec_id").isNotNull() & (F.size("v") == dim)).select("vec_id", "v", norm.alias("norm"))
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors, queries = stages.keep(usable(vectors)), stages.keep(usable(once))
    n_buckets, n_blocks = max(1, ceil(vectors.count() / bucket_rows)), max(1, ceil(queries.count() / block_rows))
    ranged = vectors.repartitionByRange(n_buckets, F.desc("norm"), "vec_id")
    bucketed = stages.keep(ranged.withColumn("bucket", F.spark_partition_id()))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    longest = bucketed.groupBy("bucket").agg(F.max("norm").alias("longest"))
    first = longest.agg(F.min("bucket"), F.max("bucket")).first()
    if first[0] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def run(asked: DataFrame, held: DataFrame) -> DataFrame:
        spread = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        grouped = asked.groupBy("bucket", "block").cogroup(spread.groupBy("bucket", "block"))

        def both(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            rows = search_bucket(q, x, k) if len(q) and len(x) else []
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

        return grouped.applyInPandas(both, "query_id long, vec_id long, score long")

    ahead = blocked.withColumn("bucket", F.lit(first[0])).withColumn("floor", F.lit(float("-inf")))
    found = stages.keep(run(ahead, bucketed.where(F.col("bucket") == first[0])))
    # k vectors reach the least of k scores; with fewer, nothing is ruled out.
    floors = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    floor = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf"))
    asked = blocked.join(floors, F.col("vec_id") == F.col("query_id"), "left").drop("query_id")
    asked = asked.withColumn("floor", F.coalesce(floor, F.lit(float("-inf")))).drop("least", "n")
    if first[1] > first[0]:
        each = asked.withColumn("bucket", F.explode(F.sequence(F.lit(first[0] + 1), F.lit(first[1]))))
        reachable = F.col("floor") <= F.col("norm") * F.col("longest") * (1 + 1e-9)
        each = each.join(longest, "bucket").where(reachable).drop("longest")
        found = found.unionByName(run(each, bucketed.where(F.col("bucket") > first[0])))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query(
    "op6_exact_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
         FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
       SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
         vec_id, score FROM p
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
)
def op6(spark, sf):
    rows = table(spark, sf, "embeddings").where(finite_vector("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    vectors = rows.select("vec_id", whole.alias("v"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
