"""From raw documents to training batches, in five stages.

Each stage takes what its predecessor kept, as a table read back from Parquet,
and returns rows with the columns of ``documents``; the last returns batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import minhash, mixing, packing, pu, suffixdedup, toxicity
from trailmark.llm.frames import table, written

#: A repeated passage has this many words, and bytes, at least: 51 short words with their spaces.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 200, 72


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = pu.score(docs, model, toxicity.features, toxicity.THRESHOLD, keep_text=True)
    return scored.filter("predicted = 0").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.deduplicated(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that repeat; n_chars counts what is left."""
    left = suffixdedup.removed(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, kept_text=True, least_words=PASSAGE_WORDS)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, in the order of the queues."""
    return mixing.served(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents."""
    return packing.batches(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot train classifiers or sample shingles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
