"""From raw documents to packed training sequences, in five stages.

1. toxicity: documents that the classifier rejects go.
2. n-gram join: one document of each group of near duplicates stays.
3. PII: personal data become pseudonyms.
4. mixing: each source is brought to its target; a document stays as often as the mix takes it.
5. packing: what is left is cut into pieces and packed into sequences.

Each stage gets what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import mixing, ngram_join, packing, pii, toxicity
from themeloom.llm.common import Stages, free_name, table

TOXIC_FROM = 0.7
#: The classifier, the forest, the mix and the packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score from which one is rejected; learned as in the toxicity query."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.is_held_out("doc_id", 3, 1))
    name = free_name(docs.columns, "score")
    scored = toxicity.score(docs, toxicity.train(docs, labels), keep_text=True)
    return scored.where(F.col(name) < TOXIC_FROM).select(docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates, and every text without words."""
    kept = ngram_join.near_duplicates(docs).where("is_first").select(
        F.col("content").alias("kept_content"), F.col("doc_id").alias("kept_id")
    )
    kept = Stages(spark).keep(kept.groupBy("kept_content", "kept_id").agg(F.count(F.lit(1)).alias("kept_n")))
    return ngram_join.rows_of(docs, kept)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms, and their new number of characters."""
    new = pii.pseudonymise(docs).select(docs.columns)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else new


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    name = free_name(docs.columns, "times")
    mixed = mixing.mix(docs, keep_text=True).where(F.col(name) > 0)
    return mixed.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece with its place in a sequence."""
    import public_tokenizers

    slim = docs.select("doc_id", "text")
    return packing.pack(slim, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_join_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table of documents."""
    stages, stored = Stages(spark), []
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir))
        stages.drop(*stored)
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
