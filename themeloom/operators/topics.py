"""Topic models and their quality measures.

theta is (id, topic, p) and beta is (topic, word, p); both sum to 1 over topics or words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import digest_number
from themeloom.operators import topic_model
from themeloom.operators.joins import attach, equi_join
from themeloom.operators.reshape import to_long, vectors_to_long
from themeloom.operators.topic_model import TopicModel
from themeloom.sources.scan import cut_lineage

DENSE_CELLS = 1 << 22
GROUP_CELLS = 1 << 22  # shares of documents, or probabilities of words, in one group of a task
SERIES_CELLS = 200_000  # topic moments of one power
MAX_ORDER = 8


def fit_topics(
    vectors: DataFrame,
    k: int,
    seed: int = 4320,
    max_iter: int = 50,
    optimizer: str = "online",
    features: str = "features",
    share: float = 1.0,
) -> TopicModel | LDAModel:
    """Latent Dirichlet allocation with k topics.

    share: the part of the documents each pass of the online optimizer reads, all of them by default. Other optimizers are
    Spark ML's own.
    """
    if optimizer == "online":
        return topic_model.fit(vectors, k, seed, max_iter, features, share)
    return LDA(k=k, seed=seed, maxIter=max_iter, optimizer=optimizer, featuresCol=features, checkpointInterval=10).fit(vectors)


def model_theta(model: TopicModel | LDAModel, vectors: DataFrame, id: str = "id") -> DataFrame:
    if isinstance(model, TopicModel):
        return vectors_to_long(model.infer(vectors, id), [id], "shares", "topic", "p")
    shares = model.transform(vectors)
    return vectors_to_long(shares, [id], "topicDistribution", "topic", "p")


def model_beta(model: TopicModel | LDAModel, words: Sequence[str]) -> DataFrame:
    """Word probabilities of a fitted model; the model already holds them on the driver."""
    if isinstance(model, TopicModel):
        names = [f"V{t + 1}" for t in range(len(model.weights))]
        shares = model.weights / model.weights.sum(axis=1, keepdims=True)
        rows = {"topic": np.repeat(names, len(words)), "word": list(words) * len(names), "p": shares.ravel()}
        return model.spark.createDataFrame(pa.table(rows))
    described = model.describeTopics(len(words))
    vocabulary = described.sparkSession.createDataFrame(list(enumerate(words)), "termIndices int, word string")
    rows = described.select("topic", F.inline(F.arrays_zip("termIndices", "termWeights")))
    named = attach(rows, vocabulary, ["termIndices"], "inner", bounded=True)
    return named.select(
        F.concat(F.lit("V"), F.col("topic") + 1).alias("topic"), "word", F.col("termWeights").alias("p")
    )


def heldout_split(
    dtm: DataFrame, doc_percent: int = 10, token_percent: int = 50, seed: int = 1, id: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Training part and held-out part: some words of some documents."""
    chosen = (digest_number(id, seed=seed, modulus=100) < doc_percent) & (
        digest_number(id, "word", seed=seed, modulus=100) < token_percent
    )
    return dtm.where(~chosen), dtm.where(chosen)


def topic_list(beta: DataFrame) -> list[str]:
    """The topics of a model in order, as many as it was fitted with."""
    return sorted(r.topic for r in beta.select("topic").distinct().collect())


def _packed(df: DataFrame, key: str, out: str, topics: Sequence[str]) -> DataFrame:
    """One array per key with the value of each topic in the order given, 0 where a topic has no row."""
    values = [F.coalesce(F.max(F.when(F.col("topic") == t, F.col("p"))), F.lit(0.0)) for t in topics]
    return df.groupBy(key).agg(F.array(*values).alias(out))


def cell_rates(dtm: DataFrame, theta: DataFrame, beta: DataFrame, id: str = "id") -> DataFrame:
    """Adds q, the fitted probability of the word in the document.

    Topics are packed into one array per document and word, so rows are not multiplied by topics.
    """
    topics = topic_list(beta)
    return _with_rates(dtm, _packed(theta, id, "_theta", topics), _packed(beta, "word", "_beta", topics), id)


def _with_rates(dtm: DataFrame, shares: DataFrame, words: DataFrame, id: str, keep: bool = False) -> DataFrame:
    """Adds q from the packed shares of the document and probabilities of the word; keep: the shares stay."""
    both = attach(dtm, words, ["word"], "inner").join(shares, id)
    products = F.zip_with("_theta", "_beta", lambda t, b: t * b)
    return both.withColumn("q", F.aggregate(products, F.lit(0.0), lambda a, x: a + x)).drop("_beta", *([] if keep else ["_theta"]))


def heldout_likelihood(heldout: DataFrame, theta: DataFrame, beta: DataFrame, id: str = "id") -> DataFrame:
    """One row: mean over documents of the mean log probability of their held-out words."""
    docs = cell_rates(heldout, theta, beta, id).groupBy(id).agg(
        (F.sum(F.col("n") * F.log("q")) / F.sum("n")).alias("d")
    )
    return docs.agg(F.round(F.avg("d"), 6).alias("likelihood"), F.count("d").alias("documents"))


def top_words(beta: DataFrame, m: int, by: Column | str = "p") -> DataFrame:
    """The m leading words per topic; a window partition is one topic's vocabulary."""
    order = Window.partitionBy("topic").orderBy(F.desc(by) if isinstance(by, str) else by.desc(), "word")
    ranked = beta.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= m)


def semantic_coherence(dtm: DataFrame, leading: DataFrame, eps: float = 0.01, id: str = "id") -> DataFrame:
    """Per topic: sum over pairs of leading words of ln((D(both) + eps) / (D(higher ranked) + eps)).

    Documents with the same set of leading words are counted together before pairs are formed, so the
    pairs come from sets of at most m words.
    """
    words = leading.select("topic", "word", "rank")
    present = attach(dtm.select(id, "word"), words.select("topic", "word", "rank"), ["word"], "inner", bounded=True)
    sets = present.groupBy(id, "topic").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    kinds = sets.groupBy("topic", "ranks").agg(F.count(F.lit(1)).alias("docs"))
    firsts = kinds.select("topic", "docs", "ranks", F.posexplode("ranks").alias("_pos", "high"))
    single = firsts.groupBy("topic", "high").agg(F.sum("docs").alias("d_high"))
    later = F.slice("ranks", F.col("_pos") + 2, F.size("ranks"))
    together = (
        firsts.select("topic", "docs", "high", F.explode(later).alias("low"))
        .groupBy("topic", "high", "low")
        .agg(F.sum("docs").alias("d_both"))
    )
    # All pairs of at most m leading words of each topic.
    listed = words.groupBy("topic").agg(F.array_sort(F.collect_list("rank")).alias("all"))
    pairs = listed.select("topic", "all", F.posexplode("all").alias("_pos", "high")).select(
        "topic", "high", F.explode(F.slice("all", F.col("_pos") + 2, F.size("all"))).alias("low")
    )
    scored = pairs.join(single, ["topic", "high"], "left").join(together, ["topic", "high", "low"], "left")
    term = F.log(
        (F.coalesce("d_both", F.lit(0)) + F.lit(eps)) / (F.coalesce("d_high", F.lit(0)) + F.lit(eps))
    )
    return scored.groupBy("topic").agg(F.round(F.sum(term), 6).alias("coherence"))


def frex_scores(beta: DataFrame, w: float = 0.5) -> DataFrame:
    """Adds frequency and exclusivity ranks per topic and their weighted harmonic mean.

    Equal values share their average rank. A window partition is one topic's vocabulary.
    """
    over_topics = beta.groupBy("word").agg(F.sum("p").alias("_all"))
    # A word has one row for each topic, so no key is hot.
    shares = equi_join(beta, over_topics, ["word"], "inner", []).withColumn("_ex", F.round(F.col("p") / F.col("_all"), 12))

    def rank_share(value: str) -> Column:
        topic = Window.partitionBy("topic")
        ties = F.count(F.lit(1)).over(Window.partitionBy("topic", value))
        place = F.rank().over(topic.orderBy(value)) + (ties - 1) / 2
        return place / F.count(F.lit(1)).over(topic)

    ranked = shares.withColumns({"fr": rank_share("p"), "ex": rank_share("_ex")})
    return ranked.withColumn("frex", 1 / (w / F.col("ex") + (1 - w) / F.col("fr"))).drop("_all", "_ex")


def exclusivity(beta: DataFrame, m: int = 10, w: float = 0.7) -> DataFrame:
    """Per topic: sum of the scores of its m most probable words."""
    leading = top_words(frex_scores(beta, w), m)
    return leading.groupBy("topic").agg(F.round(F.sum("frex"), 6).alias("exclusivity"))


@lru_cache
def _picks(k: int, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each power after the first: the column of the power before, and the topic that multiplies it."""
    steps, last = [], np.arange(k)
    for _ in range(order - 1):
        at = np.repeat(np.arange(len(last)), k - last)
        by = np.concatenate([np.arange(e, k) for e in last])
        steps.append((at, by))
        last = by
    return steps


def _monomials(shares: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Per row the products of 1, 2, ... order shares, one column for each choice of topics in rising order."""
    level = shares
    yield level
    for at, by in _picks(shares.shape[1], order):
        level = level[:, at] * shares[:, by]
        yield level


def _times_drawn(k: int, order: int) -> Iterator[np.ndarray]:
    """In how many orders the topics of each column of `_monomials` can be drawn."""
    runs = [(t, 1, 1.0) for t in range(k)]  # last topic, how often it came at the end, orders
    for size in range(1, order + 1):
        if size > 1:
            runs = [
                (t, c + 1 if t == e else 1, m * size / (c + 1 if t == e else 1))
                for e, c, m in runs
                for t in range(e, k)
            ]
        yield np.array([m for _, _, m in runs])


def series_order(k: int, cells: int = SERIES_CELLS) -> int:
    """The highest power whose topic moments are at most the given number."""
    order = 1
    while order < MAX_ORDER and math.comb(k + order, order + 1) <= cells:
        order += 1
    return order


def _moments(words: DataFrame, k: int, order: int) -> list[np.ndarray]:
    """Sums over the words of products of 1 to order word probabilities, times the orders they can be drawn in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: list = [0.0] * order
        step = max(1, DENSE_CELLS // math.comb(k + order - 1, order))
        for batch in batches:
            for start in range(0, len(batch), step):
                beta = np.stack(batch["_beta"].iloc[start : start + step].to_list())
                sums = [s + level.sum(axis=0) for s, level in zip(sums, _monomials(beta, order), strict=True)]
        for power, values in enumerate(sums):
            values = np.atleast_1d(values)
            yield pd.DataFrame({"power": power, "at": np.arange(len(values)), "x": values})

    parts = words.mapInPandas(run, "power int, at int, x double").groupBy("power", "at").agg(F.sum("x").alias("x"))
    found = [np.zeros(math.comb(k + r - 1, r)) for r in range(1, order + 1)]
    for r in parts.collect():  # at most SERIES_CELLS for each power
        found[r.power][r.at] = r.x
    return [m * times for m, times in zip(found, _times_drawn(k, order), strict=True)]


def _zero_cells(docs: DataFrame, words: DataFrame, k: int, tol: float, rest: float) -> DataFrame:
    """One row (d, cells): sums over documents and all words of m q / (1 - q), and of cells with m q > tol.

    docs is (m, _theta) and words (word, _beta, _top, _block), both stored; _top is the largest probability of the word
    in any topic, and the blocks are cut in the order of _top.

    q / (1 - q) is the power series q + q^2 + ..., and a power summed over words is a sum over topic moments. Words
    whose _top exceeds rest^(1 / order) are left out of the moments and summed one by one: at most k / rest^(1 / order)
    of them. For the others the powers beyond the order add less than rest * m / (1 - rest^(1 / order)) to a document.

    A cell can only exceed tol where _top > tol / m, which holds for at most k m / tol words. Documents of like length
    meet the blocks of words, sorted by _top, that can; neither side is ever whole in a task.
    """
    order = series_order(k)
    head = rest ** (1 / order)
    tail = _moments(words.where(F.col("_top") <= head), k, order)
    shared = docs.sparkSession.sparkContext.broadcast(tail)  # at most order * SERIES_CELLS numbers

    def series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, DENSE_CELLS // len(shared.value[-1]))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                levels = _monomials(np.stack(part["_theta"].to_list()), order)
                total = sum(level @ m for level, m in zip(levels, shared.value, strict=True))
                yield pd.DataFrame({"d": [float((total * part["m"].to_numpy()).sum())], "cells": [0]})

    # Lengths within a factor of two share a class; each class is cut into groups of about GROUP_CELLS shares.
    classed = docs.withColumn("_size", F.floor(F.log2("m")).cast("int"))
    sizes = classed.groupBy("_size").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("_most")).collect()
    if not sizes:
        return docs.sparkSession.createDataFrame([(0.0, 0)], "d double, cells long")
    groups, least = F.lit(1), F.lit(0.0)
    for r in sizes:  # one for each power of two
        groups = F.when(F.col("_size") == r["_size"], r.n * k // GROUP_CELLS + 1).otherwise(groups)
        least = F.when(F.col("_size") == r["_size"], min(head, tol / r["_most"])).otherwise(least)
    placed = classed.withColumn("_group", F.pmod(F.xxhash64("m", "_theta", F.monotonically_increasing_id()), groups))
    placed = placed.select("m", "_theta", "_size", "_group", least.alias("_least"))
    tops = words.groupBy("_block").agg(F.max("_top").alias("_block_top"))  # one for each block
    listed = F.array(*[F.struct(F.lit(r["_block"]).alias("b"), F.lit(r["_block_top"]).alias("t")) for r in tops.collect()])
    met = F.transform(F.filter(listed, lambda x: x["t"] > F.col("_least")), lambda x: x["b"])
    left = placed.withColumn("_block", F.explode(met))
    meet = F.explode(F.array(*[F.struct(F.lit(r["_size"]).alias("s"), F.lit(r.n * k // GROUP_CELLS).cast("long").alias("g"), F.lit(min(head, tol / r["_most"])).alias("l")) for r in sizes])).alias("_c")
    right = words.select("*", meet).where(F.col("_top") > F.col("_c.l")).select(
        "_beta", "_top", "_block", F.col("_c.s").alias("_size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c.g"))).alias("_group")
    )

    def dense(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        d, cells = 0.0, 0
        if len(docs) and len(words):
            words = words.sort_values("_top", ascending=False)
            top = words["_top"].to_numpy()
            beta = np.stack(words["_beta"].to_list()).T
            heads = int((top > head).sum())
            docs = docs.sort_values("m")
            m, theta = docs["m"].to_numpy(), np.stack(docs["_theta"].to_list())
            step = max(1, DENSE_CELLS // len(top))
            for start in range(0, len(m), step):
                some = m[start : start + step, None]
                reach = max(heads, int((top > tol / some.max()).sum()))
                rate = theta[start : start + step] @ beta[:, :reach]
                cells += int((rate * some > tol).sum())
                d += float((some * rate[:, :heads] / (1 - rate[:, :heads])).sum())
        return pd.DataFrame({"d": [d], "cells": [cells]})

    keys = ["_size", "_group", "_block"]
    met = left.drop("_least").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(dense, "d double, cells long")
    parts = docs.mapInPandas(series, "d double, cells long").unionAll(met)
    return parts.agg(F.sum("d").alias("d"), F.sum("cells").alias("cells"))


def residual_dispersion(
    dtm: DataFrame, theta: DataFrame, beta: DataFrame, tol: float = 0.01, id: str = "id", rest: float = 1e-9
) -> DataFrame:
    """One row: dispersion of the squared standardised residuals of all document-word cells.

    Observed cells are summed as rows. The cells with a zero count are never made into rows: their sum comes
    from moments of the topics, to within about `rest` for each word of a document, and the cells that count as
    degrees of freedom (expected count above tol) from the words probable enough for a document of its length
    (`_zero_cells`). No table of word probabilities comes to the driver.
    """
    size = beta.agg(F.sort_array(F.collect_set("topic")).alias("topics"), F.count(F.lit(1)).alias("rows")).first()
    k = len(size.topics)
    packed = _packed(beta, "word", "_beta", size.topics).withColumn("_top", F.array_max("_beta"))
    ranged = packed.repartitionByRange(size.rows // GROUP_CELLS + 1, F.desc("_top"), "word")
    words = cut_lineage(ranged.withColumn("_block", F.spark_partition_id()))
    cells = _with_rates(dtm, _packed(theta, id, "_theta", size.topics), words.select("word", "_beta"), id, keep=True)
    q, n = F.col("q"), F.col("n")
    docs = cells.groupBy(id).agg(
        F.sum(n).alias("m"), F.sum(n * n / (q * (1 - q))).alias("_a"), F.sum(n / (1 - q)).alias("_b"), F.any_value("_theta").alias("_theta")
    )
    docs = cut_lineage(docs.select("m", (F.col("_a") / F.col("m") - 2 * F.col("_b")).alias("_sparse"), "_theta"))
    zero = _zero_cells(docs.select("m", "_theta"), words, k, tol, rest).withColumn("docs", F.lit(0).cast("long"))
    seen = docs.agg(F.sum("_sparse").alias("d"), F.lit(0).cast("long").alias("cells"), F.count(F.lit(1)).alias("docs"))
    sums = seen.unionByName(zero).agg(*[F.sum(c).alias(c) for c in ("d", "cells", "docs")])
    freedom = F.col("cells") - (F.col("docs") * (k - 1) + k * (words.count() - 1))
    return sums.select(
        F.round("d", 3).alias("avvik"),
        freedom.cast("long").alias("frihetsgrader"),
        F.round(F.try_divide(F.col("d"), freedom.cast("double")), 6).alias("dispersion"),
    )


def topic_quality(dtm: DataFrame, beta: DataFrame, m: int = 10, id: str = "id") -> DataFrame:
    """Coherence and exclusivity of each topic."""
    return semantic_coherence(dtm, top_words(beta, m), id=id).join(exclusivity(beta, m), "topic")


def label_topics(beta: DataFrame, n: int = 100, w: float = 0.5) -> DataFrame:
    """Per topic: its n leading words by probability and by score, each joined to one text."""

    def joined(frame: DataFrame, by: str, out: str) -> DataFrame:
        ranked = F.array_sort(F.collect_list(F.struct("rank", "word")))
        words = F.array_join(F.transform(ranked, lambda x: x["word"]), " ")
        return top_words(frame, n, by).groupBy("topic").agg(words.alias(out))

    scored = frex_scores(beta, w).withColumn("frex", F.round("frex", 9))
    return joined(beta, "p", "sannsynlighet").join(joined(scored, "frex", "frex"), "topic")


def topic_prevalence(loadings: DataFrame, topics: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """Mean loading of the chosen topics, highest first."""
    from themeloom.operators.themes import group_mean

    means = group_mean(loadings.where(F.col("tema").isin(list(topics))), ["tema"], "ladning", "andel")
    if labels is not None:
        means = attach(means, labels, ["tema"], "left", bounded=True)
    return means.orderBy(F.desc("andel"), "tema")


def sweep_topics(
    vectors: DataFrame,
    dtm: DataFrame,
    heldout: DataFrame,
    words: Sequence[str],
    ks: Sequence[int],
    seed: int = 4320,
    max_iter: int = 50,
    id: str = "id",
) -> DataFrame:
    """Quality measures per number of topics, one row per number and measure.

    `vectors` come from the training part and are read in every iteration, so pass stored ones.
    """
    rows = []
    for k in ks:
        model = fit_topics(vectors, k, seed, max_iter)
        # One pass settles the documents for their shares and for the bound.
        inferred = cut_lineage(model.infer(vectors, id))
        theta, beta = vectors_to_long(inferred, [id], "shares", "topic", "p"), model_beta(model, words).persist()
        quality = topic_quality(dtm, beta, id=id).agg(F.avg("coherence").alias("c"), F.avg("exclusivity").alias("e"))
        quality = quality.first()
        bound = model.bound(inferred)
        rows.append(
            (
                int(k),
                bound + math.lgamma(k + 1),
                residual_dispersion(dtm, theta, beta, id=id).first().dispersion,
                quality.c,
                quality.e,
                heldout_likelihood(heldout, theta, beta, id).first().likelihood,
                float(max_iter),
            )
        )
        beta.unpersist()
    names = ["lower_bound", "residuals", "semantic_coherence", "exclusivity", "heldout_likelihood", "iterations"]
    schema = "k long, " + ", ".join(f"{n} double" for n in names)
    return to_long(vectors.sparkSession.createDataFrame(rows, schema), ["k"], names, "metric", "value")
