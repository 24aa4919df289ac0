"""From raw documents to balanced shards: the corpus operators in sequence.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Between
stages the documents are written to the shared folder and read again, so a lost executor
costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, importance, mixing, ngram_join, sharding
from weftline.session import materialise

LANGUAGES = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}  # domains and sources weigh alike
TOKEN_SHARE = (9, 10)  # of the tokens that reach the mixture
SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar shingle sets."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark passage."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, each at most once."""
    return mixing.mix(docs, LANGUAGES, share=TOKEN_SHARE, max_epochs=1)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in byte-balanced contiguous shards."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]
ORACLE_SQL = None  # the first two stages are not SQL; tests hold all against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
