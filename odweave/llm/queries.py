"""Queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.llm import collocations, deleted_interpolation, exact_dedup, langid, mixing, name_join, neighbours, ngram_join, pii, quality_rules, sentencepiece_trie, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.annotate(_table(spark, sf_dir, "documents")).drop("times")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digest(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_trie.encode(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.annotate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = _table(spark, sf_dir, "clients").select("client_id", name_join.lowered(F.col("name")).alias("name"))
    vendors = name_join.misspelt(_table(spark, sf_dir, "vendors")).select("vendor_id", name_join.lowered(F.col("name")).alias("name"))
    return name_join.link(clients, vendors)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_langid, op3_lm_score, op4_toxicity, op5_ngram_join, op6_exact_dedup, op7_neighbours, op8_mixing, op9_substring, op10_sentencepiece, op11_quality_rules, op12_name_join, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": ngram_join.SQL, "op6_exact_dedup": exact_dedup.SQL, "op9_substring": substring.SQL, "op11_quality_rules": quality_rules.SQL, "op12_name_join": name_join.SQL, "op13_collocations": collocations.SQL}
