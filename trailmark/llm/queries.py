"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linecrf, lm, media, minhash, mixing, packing, quality, sharding, suffixdedup, toxicity
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.stored(docs, media=False).withColumn("feature", F.lower(F.hex("low_hash"))).drop("low_hash")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.batches(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.fair_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_toxicity, op2_media_columns, op3_quality_rules, op4_quality_classifier, op5_packing, op6_lm_scoring, op7_mixing, op8_suffix_array_dedup, op9_sharding, op10_minhash_near_dedup)
}

ORACLES: dict[str, str] = {}
