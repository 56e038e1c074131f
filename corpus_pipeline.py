"""A training-data pipeline: quality, exact dedup, near dedup, decontamination, tokens.

STAGES are functions of (spark, docs, sf_dir); each works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontaminate, exact_dedup, minhash, quality
from tallyframe.llm.common import id_bucket, small_batches, stage

#: Documents below this score go.
LEAST_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it learns from rows of the learning
    split among the documents given."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_bucket("doc_id", 4) != 2)
    scored = quality.score(docs, quality.fit(docs, labels), score_col="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id."""
    small_batches(spark)
    return exact_dedup.drop_exact_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at five words and a similarity of 0.8, the smallest id."""
    small_batches(spark)
    return minhash.drop_near_copies(docs, width=5, percent=80)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of the benchmark."""
    small_batches(spark)
    return decontaminate.strip_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With token ids, and hashes of the ids and of what they decode to."""
    small_batches(spark)
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_near_copy),
    ("decontaminate", cut_benchmarks),
    ("encode", encode),
]

#: SQL can't express the classifier or the encoder; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"corpus-{name}")
    return docs
