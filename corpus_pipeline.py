"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's ``docs``; a lost executor costs at most a stage's
tasks. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainlens.llm import jaccard, packing, pii, quality, substring_dedup
from retainlens.llm.common import documents
from retainlens.llm.queries import tokenizer_file
from retainlens.session import ensure_checkpoint_dir, release


def _resized(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets at Jaccard 0.8 and more."""
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 50-word windows removed from the texts."""
    return _resized(substring_dedup.dedup(docs, window=50))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _resized(pii.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packing", packed)]

#: No SQL: the quality verdict, the span classifier and the tokenizer are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        release(spark)  # the next stage reads only what was written
    return docs
