"""Phrases against counts of all n-grams in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from themeloom.llm import collocations as co


def brute(rows, min_count, width, top, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, width + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= min_count:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang, words] = (score, a, f[lang, words[:k]], f[lang, words[k:]])
    inside = Counter()
    for (lang, words), (_, a, _, _) in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, words[i : i + k]
                inside[key] = max(inside[key], a)
    out = []
    for lang in n:
        mine = [
            (-s, -a, " ".join(w).encode(), left, right)
            for (g, w), (s, a, left, right) in found.items()
            if g == lang and 100 * inside[g, w] < percent * a
        ]
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def some_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "New", "YORK", "é", " ", "x" * 70, "y" * 5000]
    weights = [9, 8, 5, 5, 3, 1, 1, 0.05]
    gaps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]
    return [
        (rng.choice(["en", "en", "en", "de", None, "und", "en-x"]),
         "".join(rng.choices(words, weights)[0] + rng.choices(gaps, [40, 3, 2, 2, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("seed", "min_count", "percent"), [(1, 3, 100), (2, 10, 60)])
def test_equals_counts_of_all_ngrams(spark, seed, min_count, percent):
    rows = some_texts(seed) + [("en", None), (None, ""), ("de", " . ,, ")] + [("en", "some rare words that many rows repeat.")] * 40
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = co.collocations(docs, min_count=min_count, top=25, percent=percent, block_bytes=500)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == brute(rows, min_count, 5, 25, percent)


def test_hash_of_two_words_starts_again(spark):
    rows = some_texts(3, 20) + [("en", " ".join(f"w{i}" for i in range(50)))] * 3
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = co.collocations(docs, min_count=3, hash_bits=(5, 9, 64))
    assert rows_of(got) == brute(rows, 3, 5, 2000)


def test_hash_shared_between_blocks_is_seen():
    raw, starts, ends, _, _ = co.split_words(b"ab cd ab abc", 0)
    assert co._differ(raw, starts, ends, np.array([0, 0, 0, 0])).tolist() == [False, True, False, True]


def test_no_documents_and_no_words(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(none).collect() == []
    assert co.collocations(spark.createDataFrame([("en", " . "), (None, None)], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame(
        [("en", [1], 3_000_000_000_000), ("en", [2], 5_000_000_000_000), ("en", [1, 2], 2_999_999_999_999)],
        "lang string, words array<long>, f long",
    )
    totals = spark.createDataFrame([("en", 90_000_000_000_000_001)], "lang string, n long")
    row = co.cuts(phrases, totals).first()
    a, n, left, right = 2_999_999_999_999, 90_000_000_000_000_001, 3_000_000_000_000, 5_000_000_000_000
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 1000 * a * n // (left * right))


def test_long_text_without_breaks_and_with(spark):
    rows = [("en", "a b " * 30_000), ("en", "c d. " * 30_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(co.collocations(docs, block_bytes=1000)) == brute(rows, 100, 5, 2000)


@pytest.mark.parametrize("count", [0, 1, 5000, 70_000])
def test_filter_has_what_was_put_in(spark, count):
    keys = co.mix(np.arange(count, dtype=np.uint64) + np.uint64(1))
    frame = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    bits = co.collect_bits(frame, "key")
    assert bits.has(keys).all()
    assert bits.has(co.mix(np.arange(10**6, 10**6 + 10_000, dtype=np.uint64))).mean() < 0.1
