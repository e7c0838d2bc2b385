"""The queries of this package over the driver's tables, with their parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textweft.llm import line_dedup, mixing, quality_rules, warc
from textweft.llm.decontaminate import best_windows, contaminated
from textweft.llm.html_text import extract
from textweft.llm.near_dedup import near_duplicates
from textweft.llm.quality import quality_scores
from textweft.llm.secrets import scan
from textweft.llm.toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_windows(contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_subword_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(_table(spark, sf_dir, "documents"))


def op7_tag_path_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op8_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_windows": op1_simhash_windows,
    "op2_attention_mil": op2_attention_mil,
    "op3_hierarchical_budget": op3_hierarchical_budget,
    "op4_subword_softmax": op4_subword_softmax,
    "op5_line_hashing": op5_line_hashing,
    "op6_threshold_table": op6_threshold_table,
    "op7_tag_path_ratio": op7_tag_path_ratio,
    "op8_dictionary_warc": op8_dictionary_warc,
    "op9_prob_minhash": op9_prob_minhash,
    "op10_zstd_novelty": op10_zstd_novelty,
}

ORACLE_SQL: dict[str, str] = {
    "op3_hierarchical_budget": mixing.oracle_sql(),
    "op5_line_hashing": line_dedup.oracle_sql(),
    "op6_threshold_table": quality_rules.oracle_sql(),
    "op8_dictionary_warc": warc.oracle_sql(),
}
