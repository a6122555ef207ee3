"""The pipeline stage by stage against brute force, and registration."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from themeloom.llm import QUERIES, mixing, packing
from themeloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    before = docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SF).write.parquet(path)
        after_frame = spark.read.parquet(path)
        after = after_frame.collect()
        if name != "packing":
            assert after_frame.columns == docs.columns
        check(name, before, after, spark)
        docs, before = after_frame, after
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(after)


def check(name, before, after, spark):
    ids = [r["doc_id"] for r in before]
    if name == "toxicity":
        scores = {r["doc_id"]: r["score"] for r in QUERIES["op9_toxicity"](spark, SF).collect()}
        assert sorted(r["doc_id"] for r in after) == sorted(i for i in ids if scores[i] < 0.7)
    if name == "ngram_join":
        from test_llm_ngram_join import brute

        classes = {v[0] if v[2] else k for k, v in brute([(r["doc_id"], r["text"]) for r in before]).items()}
        assert sorted(r["doc_id"] for r in after) == sorted(classes)
    if name == "pii":
        assert sorted(r["doc_id"] for r in after) == sorted(ids)
        old = {r["doc_id"]: r for r in before}
        for r in after:
            assert r["n_chars"] == len(r["text"]) and r["source"] == old[r["doc_id"]]["source"]
            for m in re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}", old[r["doc_id"]]["text"]):
                assert m not in r["text"]
    if name == "mixing":
        from test_llm_mixing import WORD, targets

        sizes, taken, lengths = {}, {}, {}
        for r in before:
            lengths.setdefault(r["source"], []).append(len(WORD.findall(r["text"])))
            sizes[r["source"]] = sum(lengths[r["source"]])
        for r in after:
            taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
        for s, target in targets(sizes).items():
            whole = int(target // sizes[s]) * sizes[s]
            sums = {0}
            for x in lengths[s]:
                sums |= {x + y for y in sums}
            assert abs(taken.get(s, 0) - target) <= min(abs(whole + x - target) for x in sums) + 1
        counts = {i: [r["doc_id"] for r in after].count(i) for i in ids}
        assert max(counts.values()) <= 2
    if name == "packing":
        fill = {}
        for r in after:
            fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        assert max(fill.values()) <= packing.CAPACITY
        assert len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "mail me@host.example now " * 3, "en", "t", 9),
            (3, "mail me@host.example now " * 3, "en", "t", 9), (4, "x " * 20_000, "en", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["length"] <= 2048 for r in out)
    assert not np.isin([r["doc_id"] for r in out], [99]).any()
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
    assert mixing.mix(empty.withColumn("extra", F.lit(1))).count() == 0
