"""The registered queries of this subpackage, thin over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satchel.llm.bpe import bpe_round_trip, token_counts
from satchel.llm.common import table
from satchel.llm.decontaminate import contamination
from satchel.llm.jaccard import jaccard_query
from satchel.llm.licenses import license_scan
from satchel.llm.mixing import lm_scores
from satchel.llm.oracle import ORACLE_SQL
from satchel.llm.substrings import substring_dedup_query, suffix_array_dedup_query
from satchel.llm.topk import top_k_query
from satchel.llm.toxicity import toxicity_query


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_query(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_query(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_query(table(spark, sf_dir, "embeddings"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup_query(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_jaccard_join, op4_toxicity, op5_exact_top_k, op6_suffix_array_dedup, op7_license_scans, op8_lm_scoring, op9_token_counts, op10_byte_bpe)}

__all__ = ["ORACLE_SQL", "QUERIES"]
