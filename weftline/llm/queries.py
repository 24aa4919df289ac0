"""Named queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import burst_trie, collocations, decontaminate, embedding_dups, importance, licences, mixing, ngram_join, secrets, sharding, suffix_dedup, warc, wrappers
from weftline.llm.oracles import ORACLE_SQL

QUERIES = {}
MIX_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}  # domains and sources weigh alike


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op1_html_wrappers(spark, folder):
    return wrappers.extract(_table(spark, folder, "pages"))


@_query
def op2_warc_archives(spark, folder):
    read = warc.round_trip(_table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op3_byte_prefix_shards(spark, folder):
    return sharding.shard_documents(_table(spark, folder, "documents"))


@_query
def op4_cross_polytope_duplicates(spark, folder):
    return embedding_dups.near_duplicates(_table(spark, folder, "embeddings"))


@_query
def op5_spaced_seed_decontamination(spark, folder):
    found = decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.lit(True).alias("contaminated"))


@_query
def op6_ngram_jaccard_join(spark, folder):
    return ngram_join.jaccard_join(_table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@_query
def op7_licence_automaton(spark, folder):
    return licences.scan(_table(spark, folder, "documents"))


@_query
def op8_importance_resampling(spark, folder):
    return importance.kept_rows(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op9_hierarchical_mixing(spark, folder):
    found, name = mixing.chosen(_table(spark, folder, "documents"), MIX_WEIGHTS)
    return found.select("doc_id", F.substring("source", 1, 4).alias("domain"), "lang", "source", mixing.token_count(F.col("text")).alias("tokens"), F.col(name).alias("taken"))


@_query
def op10_randomness_secrets(spark, folder):
    return secrets.scan(_table(spark, folder, "documents"))


@_query
def op11_burst_trie(spark, folder):
    return burst_trie.prefix_trie(_table(spark, folder, "conversations"))


@_query
def op12_toivonen_collocations(spark, folder):
    return collocations.collocations(_table(spark, folder, "documents"))


@_query
def op13_suffix_array_dedup(spark, folder):
    found = suffix_dedup.repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
