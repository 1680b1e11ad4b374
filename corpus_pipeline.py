"""A corpus pipeline of five training-data operators over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from odweave.llm import exact_dedup, langid, mixing, ngram_join, sentencepiece_trie
from odweave.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the nearest-centroid model does not reject."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the document with the smallest doc_id."""
    return ngram_join.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document taken n times is n rows, one not taken goes."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row."""
    return sentencepiece_trie.encode(docs)


STAGES = [("language", language), ("exact dedup", exact), ("near duplicates", near), ("mixing", mixed), ("tokens", tokens)]

#: SQL cannot express the models of the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
