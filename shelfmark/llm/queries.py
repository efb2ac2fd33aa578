"""One query per operator, with production parameters, over its whole table; SQL where it can express the operator."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe, decontam, divergence, hamming, licenses, mixing, negatives, personal, quality, reputation, secrets, simhash, sql,
    suffixes,
)
from shelfmark.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("reputation")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("score")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(table(spark, sf_dir, "documents")).withColumn("base", F.sha2("base", 256)).withColumnRenamed(
        "base", "base_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_license_scan, op3_mix_sources, op4_simhash, op5_secret_scan, op6_topk_search, op7_byte_bpe,
    op8_url_filter, op9_quality_rules, op10_personal_data, op11_hard_negatives, op12_decontamination,
    op13_source_divergence)} | {"pipeline": corpus_pipeline.run}
ORACLE = {
    "op2_license_scan": sql.LICENSE_SCAN,
    "op11_hard_negatives": sql.HARD_NEGATIVES,
    "op12_decontamination": sql.DECONTAMINATION,
    "op13_source_divergence": sql.DIVERGENCE,
}
