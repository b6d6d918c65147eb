"""The corpus pipeline: quality filter, near-duplicates, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result as Parquet
in the shared folder and reads it again as the next stage's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.llm import packing, quality, shingle_dedup, substring_dedup
from quaywise.llm.common import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, in all their columns."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, threshold=0.7)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): the one with the smallest id."""
    return shingle_dedup.keep_one_of_each(docs)


def passage_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus; those with nothing left go."""
    cut = substring_dedup.without_repeats(docs, window=20)
    return cut.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: each piece of each document with its sequence and its place there."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicate_filter),
    ("passages", passage_filter),
    ("packing", pack),
]

#: The stages train a classifier and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
