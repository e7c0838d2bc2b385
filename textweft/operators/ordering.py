"""Pair ids, orders of pairs and fragments, and access to one pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweft.config import FragmentOrder, PairOrder
from textweft.plans.tables import written

_PAIR_KEY = {PairOrder.SIMILARITY: "similarity", PairOrder.TOTAL_OVERLAP: "total_overlap", PairOrder.LONGEST_FRAGMENT: "longest_fragment"}


def with_pair_id(pairs: DataFrame, n_files: int) -> DataFrame:
    """``id`` is the place of a pair in the order (0,1), (0,2) ... (1,2) ...; file ids are dense from 0."""
    left, right = F.col("left_id").cast("bigint"), F.col("right_id").cast("bigint")
    return pairs.withColumn("id", F.expr(f"cast(left_id as bigint) * ({2 * n_files} - cast(left_id as bigint) - 1) div 2") + right - left - 1)


def pair_sort_keys(order: PairOrder) -> list:
    first = [F.desc(_PAIR_KEY[order])] if order in _PAIR_KEY else []
    return [*first, F.asc("left_id"), F.asc("right_id")]


def sort_pairs(pairs: DataFrame, order: PairOrder) -> DataFrame:
    return pairs.orderBy(*pair_sort_keys(order))


def ranked_pairs(pairs: DataFrame, order: PairOrder) -> DataFrame:
    """``pairs`` with ``rank`` from 1 in an order that has no ties.

    A global rank needs the order of all pairs: the range sort is distributed, and only counts of its partitions meet.
    """
    # the sort samples its input, which would be made twice if it weren't written
    ordered = sort_pairs(written(pairs, "pairs"), order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    ordered = written(ordered, "ordered")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # the sequence number holds the partition in its high bits and the row's place in the low ones
    place = F.col("_seq") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return ordered.join(before, "_part").withColumn("rank", place + F.col("_before") + 1).drop("_part", "_seq", "_before")


def sort_fragments(fragments: DataFrame, order: FragmentOrder) -> DataFrame:
    key = {FragmentOrder.KGRAMS_ASCENDING: [F.asc("fingerprint_count")], FragmentOrder.KGRAMS_DESCENDING: [F.desc("fingerprint_count")], FragmentOrder.FILE_ORDER: []}[order]
    return fragments.orderBy("left_id", "right_id", *key, "left_start", "right_start")


def pair(pairs: DataFrame, i: int, j: int) -> DataFrame:
    """The row of a pair in either order of its ids; no row for i = j or ids out of range."""
    lo, hi = min(i, j), max(i, j)
    return pairs.filter((F.col("left_id") == lo) & (F.col("right_id") == hi))
