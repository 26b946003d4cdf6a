"""From documents to packed training sequences, in stages that each call one operator.

Every stage but the last returns rows of `documents`; the next one works on what it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from briefloom.llm import exactdedup, neardup, packing, quality, secrets
from briefloom.llm.scratch import staged


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, shingle=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", rate), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", redact), ("packing", pack)]

#: The quality stage is fitted by expectation-maximisation, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
