"""The join against brute force over all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from themeloom.llm import ngram_join
from themeloom.llm.common import Stages
from themeloom.llm.components import components


def grams(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset((n, *words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """rows: (doc_id, text) with different ids; doc_id -> (class_id, n_links, n_copies)."""
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, copies = dict.fromkeys(parent, 0), dict.fromkeys(parent, 0)
    for i, s in sets:
        copies[i] = sum(s == t for _, t in sets) if s else 0
    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if s and t and len(s & t) / len(s | t) >= 0.8:
            links[i] += 1
            links[j] += 1
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (root(i), links[i], copies[i]) for i, _ in sets}


def got(frame):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in frame.collect()}


def varied(rng, n_groups, size, words=120):
    rows, vocabulary = [], [f"w{i}" for i in range(4000)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_links_classes_and_copies_equal_brute_force(spark, block):
    rng = random.Random(4)
    rows = varied(rng, 25, 6) + [(1000 + i, t) for i, (_, t) in enumerate(varied(rng, 1, 60, 80))]
    rng.shuffle(rows)
    frame = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block)
    assert got(frame) == brute(rows)
    assert frame.where("is_first").select("class_id").distinct().count() == frame.where("is_first").count()


def test_all_levels_find_pairs_near_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        base = [f"v{rng.randrange(9000)}" for _ in range(100)]
        other = list(base)
        other[rng.randrange(5, 95)] = "changed"
        other[rng.randrange(5, 95)] = "again"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    frame = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(frame) == brute(rows)


def test_a_large_group_of_near_copies_does_not_end_the_search_for_pairs_at_the_threshold(spark):
    rng = random.Random(12)
    base = [f"g{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 10 + i % 180], f"x{i}", *base[11 + i % 180 :]])) for i in range(600)]
    for i in range(2_000):  # 80 of 100 different n-grams shared
        words = [f"p{i}w{k}" for k in range(94)]
        other = list(words)
        other[20 + rng.randrange(20)] = "changed"
        other[60 + rng.randrange(20)] = "again"
        rows += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join(other))]
    out = got(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    lost = [i for i in range(10_000, 14_000, 2) if out[i + 1] != (i, 1, 1)]
    assert len(lost) <= 2  # 0.15 expected of the shortest prefix, 8.4 of the longest alone
    assert {out[i] for i in range(600)} == {(0, 599, 1)}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  !? "), (4, "one two"), (5, "One, two!"), (6, "a b c d e f"), (7, "a b c d e g"),
            (8, "x " * 30_000), (9, "x x x x x"), (10, "one")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, class_id string, row int")
    assert got(ngram_join.near_duplicates(docs)) == brute(rows)
    assert ngram_join.near_duplicates(docs.limit(0)).collect() == []
    repeated = spark.createDataFrame([(5, "same words in all of these")] * 40 + [(None, "same words in all of these")] * 3, "doc_id long, text string")
    out = ngram_join.near_duplicates(repeated).collect()
    assert {(r["class_id"], r["n_links"], r["n_copies"]) for r in out} == {(5, 42, 43)}
    assert [r["doc_id"] for r in out if r["is_first"]] == [5]


def test_rows_of_takes_as_many_as_wanted(spark):
    docs = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (None, "u", "b"), (2, "t", "c")], "doc_id long, text string, key string")
    firsts = ngram_join.near_duplicates(docs).where("is_first").selectExpr("content AS kept_content", "doc_id AS kept_id", "1 AS kept_n")
    assert sorted(ngram_join.rows_of(docs, firsts).collect(), key=str) == sorted([(1, "t", "a"), (None, "u", "b")], key=str)


def test_target_recall_must_be_reached(spark):
    with pytest.raises(ValueError):
        ngram_join.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), depths=(8, 7))


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    frame = components(spark.createDataFrame(edges, "a long, b long"), Stages(spark))
    rows = {r["node"]: r["root"] for r in frame.collect()}
    expected = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}
    assert rows == expected and frame.count() == len(expected)
    assert components(spark.createDataFrame([], "a long, b long"), Stages(spark)).collect() == []


def test_null_id_and_the_id_none_are_two(spark):
    docs = spark.createDataFrame([("none", "a b", 1), (None, "a b", 2), (None, "a b", 3)], "doc_id string, text string, x int")
    content = F.xxhash64("text").alias("kept_content")
    kept = docs.where("x < 3").select(content, F.col("doc_id").alias("kept_id"), F.lit(1).cast("long").alias("kept_n"))
    got = [sorted(r.x for r in ngram_join.rows_of(docs.repartition(n), kept).collect()) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 2 and got[0][0] == 1
