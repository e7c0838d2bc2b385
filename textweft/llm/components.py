"""Connected components of a link table by repeated contraction, without a driver-side structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweft.plans.tables import written


def components(links: DataFrame) -> DataFrame:
    """``(node, class_id)`` for every node of ``links(a, b)``: the smallest node that it is connected with.

    Each round maps every node to the neighbour (or itself) that comes first in a random order and replaces links by
    links between images. Equal ends vanish, so a star is done in one round and any graph in logarithmically many. A map
    and its links are written tables, and maps are composed at the end.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    maps, round_ = [], 0
    while not edges.isEmpty():
        round_ += 1
        order = F.struct(F.xxhash64("v", F.lit(round_)), "v")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        best = both.groupBy("u").agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(round_)), F.col("u").alias("v"))
        image = written(best.select("u", F.least("m", own)["v"].alias("to")), "image")
        maps.append(image)
        half = edges.join(image, F.col("a") == F.col("u")).select(F.col("to").alias("a"), "b")
        edges = written(
            half.join(image, F.col("b") == F.col("u")).select("a", F.col("to").alias("b")).filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("class_id")).limit(0)
    root = maps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for image in maps[1:]:
        root = root.join(image, F.col("root") == F.col("u"), "left").select("node", F.coalesce("to", "root").alias("root"))
    root = written(root, "roots")
    least = written(root.groupBy("root").agg(F.min("node").alias("class_id")), "classes")
    return written(root.join(least, "root").select("node", "class_id"), "components")
