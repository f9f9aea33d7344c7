"""Queries of this subpackage, by name; each applies its operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from . import decontaminate, language_model, licences, near_duplicates, packing, passages, resample, sharding, surrogates, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.perplexity(spark, _table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, _table(spark, sf_dir, "documents"), sharding.copies())


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, _table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.counted(licences.scan(spark, _table(spark, sf_dir, "documents")))


def op6_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.sample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(spark, _table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_model, op2_sharding, op3_top_k, op4_pii, op5_licences, op6_resample, op7_decontaminate, op8_passages, op9_packing, op10_near_duplicates)}
ORACLE_SQL = {"op3_top_k": topk.ORACLE, "op5_licences": licences.oracle(), "op7_decontaminate": decontaminate.ORACLE}
