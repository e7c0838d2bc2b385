"""Labels for training: a bounded sample of the rows that aren't held out, and columns that a score adds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textweft.llm import textkernel as tk


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no training may see: crc32 of the doc_id as text, modulo 4, is 2. False for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, label, text)`` of at most ``most`` labelled ids that aren't held out, the first in a random but fixed order.

    Ids whose labels are null or contradict each other aren't used. An id has one row: of several texts the first in order.
    """
    one = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = one.groupBy("doc_id").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = hi")
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("lo").alias("label")).collect()
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", T.IntegerType())])
    few = spark.createDataFrame([(r["doc_id"], int(r["label"])) for r in first], schema)
    some = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most ``most`` rows of two numbers
    return some.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def within(table: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows of ``table(place, ...)`` in order of ``place``, as far as the sum of ``size`` isn't above ``most``.

    ``table`` has a row for each document of a sample, which has a bound.
    """
    used, last = 0, None
    for r in table.groupBy("place").agg(F.sum(size).alias("n")).orderBy("place").toLocalIterator():
        used += r["n"]
        if used > most:
            break
        last = r["place"]
    return table.filter(F.col("place") <= last) if last is not None else table.limit(0)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], column: str) -> DataFrame:
    """``docs`` and a double column ``column`` that ``score`` gives for each slice of texts. No text is cut and no row dropped."""
    tk.small_batches(docs.sparkSession)
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tk.slices(batch["text"]):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(texts), pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def results(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    return scored(docs.select("doc_id", "text"), score, "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
