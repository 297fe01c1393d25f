"""The corpus pipeline: language, quality, near duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontam, langid, neardup, ruleclf
from corpusloom.llm.common import bound_batches, free_name, in_learning_part, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject (no letters, or unlike every language) go."""
    out = langid.identify(docs, docs.where(in_learning_part(F.col("doc_id"))))
    return out.where(~F.col(free_name(docs, "language"))["rejected"]).select(*docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below its threshold go."""
    return ruleclf.score_documents(docs, table(spark, sf_dir, "labels")).where(F.col(free_name(docs, "quality_good"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    return neardup.deduplicate(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and the hash of the text decoded from them."""
    bound_batches(spark)
    t = bpe.round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    out = docs.select("doc_id", t.alias("t"))
    return out.select("doc_id", F.col("t.n_tokens").alias("n_tokens"), F.sha2("t.ids", 256).alias("ids_sha256"), F.sha2(F.col("t.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("tokens", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
