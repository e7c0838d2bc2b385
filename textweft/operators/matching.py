"""Maximal exact matches between sequences and the metrics of pairs, as joins, islands and aggregates.

Symbols are joined on their value; consecutive hits on one diagonal are an island, and an island is a maximal match. Ignored
positions are taken out before the join but keep their numbers, so they cut islands and never close them up. A value that
very many sequences share has many hits; adaptive execution splits such a key over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweft.plans.tables import written

KEY = ["left_id", "right_id"]


def matches(live: DataFrame, min_length: int = 1) -> DataFrame:
    """``(left_id, right_id, left_start, right_start, length)`` of every maximal common run of ``live(file_id, idx, h)``.

    ``left_id < right_id``. Runs within one sequence don't count. Of longer runs only places are joined at which ``min_length`` symbols
    in a row are equal, which are far fewer than equal symbols: a run of n has n - min_length + 1 of them.
    """
    symbols = ["h", *(f"h{m}" for m in range(1, min_length))]
    if min_length > 1:
        order = Window.partitionBy("file_id").orderBy("idx")
        rows = live.select("file_id", "idx", "h", *(F.lead("h", m).over(order).alias(f"h{m}") for m in range(1, min_length)), (F.lead("idx", min_length - 1).over(order) - F.col("idx")).alias("ahead"))
        live = written(rows.filter(F.col("ahead") == min_length - 1).drop("ahead"), "grams")
    x, y = live.alias("x"), live.alias("y")
    same = F.col("x.file_id") < F.col("y.file_id")
    for h in symbols:
        same = same & (F.col(f"x.{h}") == F.col(f"y.{h}"))
    hits = x.join(y, same)
    hits = hits.select(F.col("x.file_id").alias("left_id"), F.col("y.file_id").alias("right_id"), F.col("x.idx").alias("i"), (F.col("y.idx") - F.col("x.idx")).alias("diagonal"))
    return _runs(hits, 1).withColumn("length", F.col("length") + max(0, min_length - 1))


def matches_with_stored(new: DataFrame, stored: DataFrame, min_length: int = 1) -> DataFrame:
    """Matches of ``new`` sequences with each other and with ``stored`` ones; pairs of stored sequences aren't made again.

    Ids of the two are different.
    """
    x, y = new.alias("x"), stored.alias("y")
    less = F.col("x.file_id") < F.col("y.file_id")
    side = lambda a, b: F.when(less, F.col(a)).otherwise(F.col(b))
    across = x.join(y, F.col("x.h") == F.col("y.h")).select(
        side("x.file_id", "y.file_id").alias("left_id"), side("y.file_id", "x.file_id").alias("right_id"), side("x.idx", "y.idx").alias("i"), (side("y.idx", "x.idx") - side("x.idx", "y.idx")).alias("diagonal")
    )
    return _runs(across, min_length).union(matches(new, min_length))


def _runs(hits: DataFrame, min_length: int) -> DataFrame:
    """Islands of consecutive hits on a diagonal; their window and aggregate share one exchange."""
    order = Window.partitionBy(*KEY, "diagonal").orderBy("i")
    islands = hits.withColumn("island", F.col("i") - F.row_number().over(order))
    runs = islands.groupBy(*KEY, "diagonal", "island").agg(F.min("i").alias("left_start"), F.count("*").cast("int").alias("length"))
    return runs.filter(F.col("length") >= min_length).select(*KEY, "left_start", (F.col("left_start") + F.col("diagonal")).alias("right_start"), "length")


def without_contained(found: DataFrame) -> DataFrame:
    """Matches that lie in no other match on both sides; each is compared with all others of its pair."""
    a, b = found.alias("a"), found.alias("b")
    inside = (
        (F.col("a.left_id") == F.col("b.left_id")) & (F.col("a.right_id") == F.col("b.right_id"))
        & (F.col("b.left_start") <= F.col("a.left_start")) & (F.col("a.left_start") + F.col("a.length") <= F.col("b.left_start") + F.col("b.length"))
        & (F.col("b.right_start") <= F.col("a.right_start")) & (F.col("a.right_start") + F.col("a.length") <= F.col("b.right_start") + F.col("b.length"))
        & ((F.col("a.left_start") != F.col("b.left_start")) | (F.col("a.right_start") != F.col("b.right_start")))
    )
    return a.join(b, inside, "left_anti")


def totals(files: DataFrame, live: DataFrame) -> DataFrame:
    """``(file_id, total)``: live positions of each file, 0 for files without any."""
    counts = live.groupBy("file_id").agg(F.count("*").alias("total"))
    return files.select("file_id").join(counts, "file_id", "left").select("file_id", F.coalesce("total", F.lit(0)).alias("total"))


def _fresh(start: str) -> Column:
    """Positions of a match that no match before it covers, in order of ``start``."""
    before = Window.partitionBy(*KEY).orderBy(start, "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col(start) + F.col("length")
    return F.greatest(F.lit(0), end - F.greatest(F.col(start), F.coalesce(F.max(end).over(before), F.lit(0))))


def overlaps(found: DataFrame) -> DataFrame:
    """``(left_id, right_id, overlap_left, overlap_right, longest_fragment, fragment_total)`` of pairs with a match.

    Both running maxima and the sums are over the same key, so they share one exchange.
    """
    fresh = found.withColumn("fresh_left", _fresh("left_start")).withColumn("fresh_right", _fresh("right_start"))
    return fresh.groupBy(*KEY).agg(
        F.sum("fresh_left").alias("overlap_left"), F.sum("fresh_right").alias("overlap_right"), F.max("length").cast("bigint").alias("longest_fragment"), F.sum("length").alias("fragment_total")
    )


def metrics(files: DataFrame, live: DataFrame, found: DataFrame, all_pairs: bool = False) -> DataFrame:
    """``(left_id, right_id, similarity, longest_fragment, overlap_left, overlap_right, total_left, total_right, total_overlap)``.

    Pairs without a match are left out, or have zeros if ``all_pairs``: then there are n(n-1)/2 rows, which is what is asked for.
    """
    return with_totals(files, live, overlaps(found), all_pairs)


def with_totals(files: DataFrame, live: DataFrame, sparse: DataFrame, all_pairs: bool = False) -> DataFrame:
    """The rows of ``metrics`` from the overlaps of pairs."""
    total = totals(files, live)
    left = total.select(F.col("file_id").alias("left_id"), F.col("total").alias("total_left"))
    right = total.select(F.col("file_id").alias("right_id"), F.col("total").alias("total_right"))
    if all_pairs:
        pairs = left.join(right, F.col("left_id") < F.col("right_id")).join(sparse, KEY, "left")
    else:
        pairs = sparse.join(left, "left_id").join(right, "right_id")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("overlap_left", "overlap_right", "longest_fragment")}
    pairs = pairs.withColumns(zero)
    both, all_ = F.col("overlap_left") + F.col("overlap_right"), F.col("total_left") + F.col("total_right")
    similarity = F.when(all_ == 0, F.lit(0.0)).otherwise(both.cast("double") / all_)
    return pairs.select(*KEY, similarity.alias("similarity"), "longest_fragment", "overlap_left", "overlap_right", "total_left", "total_right", both.alias("total_overlap"))


def fragments(found: DataFrame, prints: DataFrame) -> DataFrame:
    """Matches with the regions of both files: ``left_*`` and ``right_*`` of start and end, and ``fingerprint_count``."""

    def ends(side: str, which: str) -> DataFrame:
        names = ("start_row", "start_col") if which == "start" else ("end_row", "end_col")
        return prints.select(F.col("file_id").alias(f"{side}_id"), F.col("idx").alias(f"{side}_{which}_idx"), *(F.col(n).alias(f"{side}_{n}") for n in names))

    out = found
    for side in ("left", "right"):
        out = out.withColumn(f"{side}_start_idx", F.col(f"{side}_start")).withColumn(f"{side}_end_idx", F.col(f"{side}_start") + F.col("length") - 1)
        for which in ("start", "end"):
            out = out.join(ends(side, which), [f"{side}_id", f"{side}_{which}_idx"])
    regions = [f"{s}_{n}" for s in ("left", "right") for n in ("start_row", "start_col", "end_row", "end_col")]
    return out.select(*KEY, "left_start", "right_start", *regions, F.col("length").alias("fingerprint_count"))
