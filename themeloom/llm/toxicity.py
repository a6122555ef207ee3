"""Toxicity from subword bags: character n-gram vectors, averaged, into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into a fixed number of buckets), so a
misspelling that was never seen shares most of them. A window of words is the mean of its words, and a
linear softmax sits on top; vectors and softmax are trained together in numpy on a bounded sample of the
labelled rows. Averaging a whole long text would drown a few words, so a text is scored by its worst
window. Training starts with whole texts and goes on with the window of each text that looks worst so
far. As everything behind the vectors is linear, a trained model is one number for each bucket, and so is the
mean of several: some models leave out each labelled text, and an isotonic curve over what these say of
it turns logits into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.calibration import isotonic
from themeloom.llm.common import free_name, query, table

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 2
MAX_TOXIC = 2_500  # labelled rows to learn from, at most
MAX_CLEAN = 5_000
MAX_CHARS = 20_000  # longer texts are not learned from (all are scored, whole)
SEED = 7
FOLDS = 3  # parts of the rows; each is left to the calibration by one model of each repeat
REPEATS = 2  # of the split into parts; all models are averaged
ROUNDS = 8  # searches for the worst windows while training
CURVE = 0.001  # part of the logistic curve in a score
CACHED_WORDS = 400_000

WORDS = re.compile(r"\w+")
_caches: dict[str, dict] = {}


def grams(words: list[str], buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every n-gram of `<word>`, sorted by word; every word has one."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    at, found = [], []
    with np.errstate(over="ignore"):
        hashed = np.zeros(len(codes), np.uint64)
        for n in range(1, max(sizes) + 1):
            hashed = hashed[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
            if n in sizes:
                whole = owner[: len(hashed)] == owner[n - 1 :]
                mixed = (hashed[whole] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(40)) % np.uint64(buckets))
                at.append(owner[: len(hashed)][whole])
    at, found = np.concatenate(at), np.concatenate(found).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], found[order]


@dataclass(frozen=True)
class ToxicityModel:
    """scores: a number for each bucket; a window's logit is bias plus the mean over its words."""

    scores: np.ndarray
    bias: float
    slope: float
    shift: float
    window: int
    constant: float | None = None
    name: str = ""
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        at, found = grams(words, len(self.scores))
        return np.bincount(at, self.scores[found], len(words)) / np.bincount(at, minlength=len(words))

    def probability(self, logit: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        curve = 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30)))
        # Shares have plains; a little of the curve keeps the order on them.
        return curve if self.steps is None else (1 - CURVE) * np.interp(logit, *self.steps) + CURVE * curve


def worst_window(scores: np.ndarray, window: int) -> tuple[int, float]:
    """Start and mean of the highest window; a shorter text is one window, an empty one has mean 0."""
    if len(scores) <= window:
        return 0, float(scores.mean()) if len(scores) else 0.0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    means = (sums[window:] - sums[:-window]) / window
    at = int(np.argmax(means))
    return at, float(means[at])


class _Trainer:
    """Embeddings and softmax, with steps scaled by past gradients."""

    def __init__(self, starts: np.ndarray, found: np.ndarray, rng: np.random.Generator, rate: float = 0.3):
        self.starts, self.found, self.rng, self.rate = starts, found, rng, rate
        self.E = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32) / DIM
        self.W = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.gE = np.full(BUCKETS, 1e-6, np.float32)
        self.gW, self.gb = np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def step(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> None:
        sizes = np.array([len(x) for x in bags])
        uniq, inv = np.unique(np.concatenate(bags), return_inverse=True)
        counts = self.starts[uniq + 1] - self.starts[uniq]
        begin = np.cumsum(counts) - counts
        found = self.found[np.repeat(self.starts[uniq] - begin, counts) + np.arange(counts.sum())]
        words = np.add.reduceat(self.E[found], begin, axis=0) / counts[:, None]
        means = np.add.reduceat(words[inv], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        logits = means @ self.W + self.b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(bags)), labels] -= 1
        p *= (weights / weights.sum())[:, None]
        dW, db, dmeans = means.T @ p, p.sum(0), p @ self.W.T
        per_token = np.repeat(dmeans / sizes[:, None], sizes, axis=0)
        dwords = np.stack([np.bincount(inv, per_token[:, k], len(uniq)) for k in range(DIM)], 1) / counts[:, None]
        touched, place = np.unique(found, return_inverse=True)
        per_gram = np.repeat(dwords, counts, axis=0)
        dE = np.stack([np.bincount(place, per_gram[:, k], len(touched)) for k in range(DIM)], 1)
        self.gE[touched] += (dE**2).mean(1)
        self.E[touched] -= (self.rate * dE / np.sqrt(self.gE[touched])[:, None]).astype(np.float32)
        self.gW += dW**2
        self.gb += db**2
        self.W -= self.rate * 0.2 * dW / np.sqrt(self.gW)
        self.b -= self.rate * 0.2 * db / np.sqrt(self.gb)

    def epoch(self, bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, size: int) -> None:
        order = self.rng.permutation(len(bags))
        for i in range(0, len(order), size):
            at = order[i : i + size]
            self.step([bags[j] for j in at], labels[at], weights[at])

    def scores(self) -> tuple[np.ndarray, float]:
        way = self.W[:, 1] - self.W[:, 0]
        return self.E @ way, float(self.b[1] - self.b[0])


def fit(texts: list[str], labels: list[int], shares: tuple[float, float], window: int = WINDOW, seed: int = SEED) -> ToxicityModel:
    """A model from labelled texts; shares: how frequent clean and toxic rows are among all labelled ones."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        # Nothing to tell apart: the smoothed share of toxic rows for every text.
        return ToxicityModel(np.zeros(1), 0.0, 0.0, 0.0, window, (float(y.sum()) + 0.5) / (len(y) + 1))
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in WORDS.findall(t.lower())], np.int32) for t in texts]
    vocabulary = list(ids)
    at, found = [], []
    for i in range(0, len(vocabulary), 20_000):
        a, f = grams(vocabulary[i : i + 20_000])
        at.append(a + i)
        found.append(f.astype(np.int32))
    at, found = np.concatenate(at), np.concatenate(found)
    starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(vocabulary)))))
    gram_counts = np.diff(starts)
    some = [i for i, d in enumerate(docs) if len(d)]
    rng.shuffle(some)
    members, unseen = [], {i: [] for i in some}
    splits = [[]]
    if len(some) >= 2 * FOLDS:
        orders = [rng.permutation(some) for _ in range(REPEATS)]
        splits = [order[k::FOLDS].tolist() for order in orders for k in range(FOLDS)]
    for k, held in enumerate(splits):
        used = sorted(set(some) - set(held))
        by_bucket, bias = _train_member(docs, y, used, starts, found, window, np.random.default_rng([seed, k]))
        by_word = np.add.reduceat(by_bucket[found], starts[:-1]) / gram_counts
        for i in held or used:
            unseen[i].append(by_word[docs[i]])
        members.append((by_bucket, bias))
    # The mean of linear models is a linear model; the curve comes from texts that some members have not seen.
    mean_bias = float(np.mean([b for _, b in members]))
    logits = np.array([worst_window(np.mean(unseen[i], axis=0), window)[1] + mean_bias for i in some])
    slope, shift = calibrate(logits, y[some], shares)
    steps = risen_shares(logits, y[some], shares)
    scores = np.mean([m for m, _ in members], axis=0)
    bias = float(np.mean([b for _, b in members]))
    return ToxicityModel(scores.astype(np.float32), bias, slope, shift, window, None, f"{seed}-{hash(scores.tobytes())}", steps)


def risen_shares(logits: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> tuple[np.ndarray, np.ndarray] | None:
    """Rising logits and the smoothed shares of toxic texts around them, classes weighted as frequent as they are."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return None
    order = np.argsort(logits, kind="stable")
    weight = (np.array(shares) / n * len(y))[y[order]]
    return isotonic(logits[order], weight, weight * y[order])


def _train_member(
    docs: list[np.ndarray], y: np.ndarray, used: list[int], starts: np.ndarray, found: np.ndarray, window: int, rng: np.random.Generator
) -> tuple[np.ndarray, float]:
    """A number for each bucket, and the bias, from the used texts."""
    gram_counts = np.diff(starts)
    trainer = _Trainer(starts, found, rng)
    marks = y[used]
    class_weight = np.array([1.0 / max(1, (marks == 0).sum()), 1.0 / max(1, (marks == 1).sum())]) * len(marks) / 2
    whole = [np.unique(docs[i]) for i in used]
    for _ in range(2):
        trainer.epoch(whole, marks, class_weight[marks], 64)
    for _ in range(ROUNDS):
        by_word = np.add.reduceat(trainer.scores()[0][found], starts[:-1]) / gram_counts
        bags, labels = [], []
        for i in used:
            start, _ = worst_window(by_word[docs[i]], window)
            bags.append(docs[i][start : start + window])
            labels.append(y[i])
            if y[i] == 0:
                start = int(rng.integers(0, max(1, len(docs[i]) - window + 1)))
                bags.append(docs[i][start : start + window])
                labels.append(0)
        for _ in range(2):
            trainer.epoch(bags, np.array(labels), np.ones(len(labels)), 256)
    return trainer.scores()


def calibrate(logits: np.ndarray, y: np.ndarray, shares: tuple[float, float], rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve with smoothed targets, classes weighted as frequent as they are."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return 1.0, 0.0
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.array([shares[0] / n[0], shares[1] / n[1]])[y] * len(y)
    X = np.stack([logits, np.ones(len(y))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        gradient = X.T @ (weight * (p - target)) + 1e-3 * beta
        hessian = (X * (weight * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def is_held_out(doc_id: str, modulo: int, remainder: int) -> F.Column:
    """Rows that nothing is learned from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulo == remainder, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS
) -> ToxicityModel:
    """Learns from a bounded sample of the labelled rows (doc_id, toxic), drawn by a hash of the id.

    At most max_toxic and max_clean rows, of texts up to max_chars characters, reach the driver. Of labels
    that contradict each other for an id, toxic counts. Rows with a null id, label or text are not used.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = one.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    drawn = [
        one.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
        for mark, most in ((0, max_clean), (1, max_toxic))
    ]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most max_toxic + max_clean rows
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, max_chars)).join(ids, "doc_id")
    rows = texts.orderBy("doc_id", "text").limit(2 * (max_toxic + max_clean)).toArrow()  # ids may repeat
    n = max(1, sum(totals))
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), (totals[0] / n, totals[1] / n))


def score(
    docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", keep_text: bool = False
) -> DataFrame:
    """All columns (the text only with keep_text) and the probability that the whole text is toxic; no shuffle.

    Null, empty and wordless texts get the score of the bias alone. Every row stays; a column called like
    `out` stays and the new one gets underscores before it.
    """
    kept = [c for c in docs.columns if keep_text or c != text]
    out = free_name(kept, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each of a fixed number of buckets
    columns = [F.col(f"`{c}`") for c in kept]
    schema = docs.select(*columns, F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cache = _caches.setdefault(known.name, {})
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                words = [WORDS.findall((t or "").lower()) for t in batch.column(batch.num_columns - 1).to_pylist()]
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                new = list({w for ws in words for w in ws if w not in cache})
                cache.update(zip(new, known.word_scores(new).tolist(), strict=True))
                logits = [worst_window(np.array([cache[w] for w in ws]), known.window)[1] + known.bias for ws in words]
                scores = pa.array(known.probability(np.array(logits)), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*kept, out])

    return docs.select(*columns, F.col(f"`{text}`").alias("scored_text")).mapInArrow(run, schema)


@query("op9_toxicity")
def op9(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = train(docs, labels.where(~is_held_out("doc_id", 3, 1)))
    scored = score(docs.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
