"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and reread as the next one's.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; ``sf_dir`` is where labels and benchmark
are. All but the last return the columns of ``docs``, whatever they are called; the last adds ``copies``, with underscores before it if
there is such a column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textweft.llm.decontaminate import keep_clean
from textweft.llm.mixing import mix_rows
from textweft.llm.near_dedup import keep_first
from textweft.llm.quality import keep_good
from textweft.llm.secrets import redact
from textweft.plans.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of those that reach this stage.

    A null or empty text is an empty passage and scored like any other. Rows without a doc_id are scored, too. Repeated rows stay or go
    together. An empty table gives an empty one.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id; of repeated rows one.

    Texts without a word and rows without a doc_id are in no class and stay. An empty table gives an empty one.
    """
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id.

    Null and empty texts and rows without a doc_id stay. Items without a word match nothing. An empty table gives an empty one.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every row stays, null and empty texts as they are, repeated rows each."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the sources' target weights, with the number of epochs that each is in, ``copies``.

    Null languages and sources are the empty one. Rows without a token are never chosen; rows of one doc_id, or without one, are taken
    together in a leaf. An empty table gives an empty one.
    """
    return mix_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: Trained models, similarity search and compression can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
