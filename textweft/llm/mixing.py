"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Sources stand in a tree: domain, language, source. A budget of tokens goes down the tree. At every node it is dealt to the children in
proportion to their weights; a child can hold at most its tokens times the allowed epochs, and what it can't hold goes to its
siblings by weight. A node's room is the sum of its leaves', so a shortage leaves a node only when all below it is full, and then goes
to the node's own siblings.

A leaf's budget is spent in epochs. An epoch is all its documents in an order seeded by epoch; the last is a prefix of that order
whose tokens fit what is left. The prefix ends at one position of the order, found by summing tokens over 1,024 ranges of
positions, then over 1,024 ranges of the one that holds the end, and then over the rows of that range, so no leaf is sorted in a task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textweft.plans.tables import written

WORD = "[^\\x20\\x09-\\x0D]+"
LEAF = ["domain", "language", "origin"]


class Mix(NamedTuple):
    """Weights are whole numbers; a name that isn't listed has weight 1. ``domains`` lists the sources of each domain."""

    domains: dict[str, tuple[str, ...]] = {
        "web": ("src0", "src1", "src2", "src3", "src4"),
        "reference": ("src5", "src6", "src7", "src8", "src9"),
        "books": ("src10", "src11", "src12", "src13", "src14"),
    }
    domain: dict[str, int] = {"web": 4, "reference": 3, "books": 2, "other": 1}
    language: dict[str, int] = {"en": 6, "de": 2, "fr": 2, "es": 1}
    source: dict[str, int] = {"src0": 2, "src5": 3}
    #: Tokens wanted, in percent of those there are; epochs of a source at most; seed of the orders.
    percent: int = 60
    epochs: int = 3
    seed: int = 42


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def domain_sql(mix: Mix) -> str:
    cases = " ".join(f"when source in ({', '.join(map(_quoted, s))}) then {_quoted(d)}" for d, s in mix.domains.items())
    return f"case {cases} else 'other' end" if cases else "'other'"


def weight_sql(column: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"when {column} = {_quoted(k)} then {w}" for k, w in weights.items())
    return f"cast(case {cases} else 1 end as bigint)" if cases else "cast(1 as bigint)"


def _dealt(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` with ``budget``: the share of ``parent_budget`` of each node that weight ``w`` and room ``cap`` allow.

    In order of room per weight the nodes that fill up come first; each is full if its room is no more than its share of what the
    ones before it leave.
    """
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(F.col("cap") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, -1)
    some = nodes.filter("w > 0").withColumn("cc", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("cw", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("all_w", F.sum("w").over(siblings))
    some = some.withColumn("full", F.expr("cap * (all_w - cw) <= w * (parent_budget - cc)"))
    some = some.withColumn("full_cap", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0))).withColumn("full_w", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(siblings), F.lit(0)))
    return some.withColumn("budget", F.expr("case when full then cap else least(cap, w * (parent_budget - full_cap) div (all_w - full_w)) end")).drop("cc", "cw", "all_w", "full", "full_cap", "full_w")


def with_leaf(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with its leaf and ``n_tokens``; a null language or source is the empty one."""
    return docs.withColumn("domain", F.expr(domain_sql(mix))).withColumn("language", F.coalesce("lang", F.lit(""))).withColumn("origin", F.coalesce("source", F.lit(""))).withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))


def budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, language, origin, tokens, budget)`` of each leaf of ``tokens(domain, language, origin, n_tokens)``."""
    leaves = written(tokens.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * mix.epochs), "leaves")
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("w", F.expr(weight_sql("domain", mix.domain)))
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).withColumn("parent_budget", F.expr(f"`all` * {mix.percent} div 100")).drop("all")
    top = _dealt(top.crossJoin(F.broadcast(whole)), [], "domain")  # whole is one row
    middle = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("w", F.expr(weight_sql("language", mix.language)))
    middle = _dealt(middle.join(top.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"], "language")
    low = leaves.withColumn("w", F.expr(weight_sql("origin", mix.source))).join(middle.select("domain", "language", F.col("budget").alias("parent_budget")), ["domain", "language"])
    return written(_dealt(low, ["domain", "language"], "origin").select(*LEAF, "tokens", "budget"), "budgets")


def position(mix: Mix, epoch: str, doc_id: str = "doc_id") -> str:
    """SQL for a document's place in the order of an epoch, 60 bits; Spark's dialect."""
    return f"cast(conv(substr(md5(concat('{mix.seed}:', cast({epoch} as string), ':', coalesce(cast({doc_id} as string), ''))), 1, 15), 16, 10) as bigint)"


def cuts(tokens: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, language, origin, tokens, budget, epochs, cut)``: whole epochs of each leaf, and the last position taken in the one after."""
    leaf = budgets(tokens, mix).filter("tokens > 0").withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    leaf = written(leaf, "leaf")
    at = tokens.filter("n_tokens > 0").join(leaf.select(*LEAF, "epochs", "rest").filter("rest > 0"), LEAF).withColumn("h", F.expr(position(mix, "epochs")))
    left = at.select(*LEAF, "h", "rest", "n_tokens")
    for shift in (50, 40):
        # the range of positions where the running sum passes the rest; what stands before it is taken whole
        sums = left.groupBy(*LEAF, F.shiftright("h", shift).alias("range")).agg(F.sum("n_tokens").alias("n"), F.min("rest").alias("rest"))
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("range")))
        end = written(running.filter("upto > rest and upto - n <= rest").select(*LEAF, "range", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), "range")
        left = left.drop("rest").withColumn("range", F.shiftright("h", shift)).join(end, [*LEAF, "range"]).drop("range")
    # rows of one position, as those without a doc_id, are one
    left = left.groupBy(*LEAF, "h").agg(F.sum("n_tokens").alias("n_tokens"), F.min("rest").alias("rest"))
    tail = left.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("h")))
    # the range begins where the ones before it end, so all that is taken has a position below it or up to this
    last = tail.groupBy(*LEAF).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("h"))).alias("last"), F.min("h").alias("first"))
    cut = written(last.select(*LEAF, F.coalesce("last", F.col("first") - 1).alias("cut")), "cut")
    return written(leaf.join(cut, LEAF, "left").drop("rest"), "cuts")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The chosen rows of ``docs(doc_id, text, lang, source, ...)`` as ``(doc_id, domain, language, origin, n_tokens, copies)``.

    ``copies`` is the number of epochs that a row is in. Tokens are runs of characters other than blank and U+0009 to U+000D. Rows
    without a token are never chosen. Rows of one doc_id in a leaf, or without a doc_id, have one position and are taken together or
    not at all. A node's budget is rounded down. An empty table gives an empty one. Other columns are ignored.
    """
    tokens = written(with_leaf(docs.select("doc_id", "text", "lang", "source"), mix).select("doc_id", *LEAF, "n_tokens"), "tokens")
    return _chosen(tokens, cuts(tokens, mix), mix).select("doc_id", *LEAF, "n_tokens", "copies")


def mix_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The chosen rows of ``docs`` with their own columns and ``copies``, with underscores before it if a column has that name."""
    own, copies = docs.columns, "copies"
    while copies in own:
        copies = f"_{copies}"
    tokens = with_leaf(docs.select("doc_id", "text", "lang", "source"), mix).select("doc_id", *LEAF, "n_tokens")
    whole = with_leaf(docs.select(F.struct(*own).alias("_row"), "doc_id", "text", "lang", "source"), mix).drop("text", "lang", "source")
    return _chosen(whole, cuts(written(tokens, "tokens"), mix), mix).select(*(F.col("_row")[c].alias(c) for c in own), F.col("copies").alias(copies))


def _chosen(rows: DataFrame, leaf: DataFrame, mix: Mix) -> DataFrame:
    joined = rows.filter("n_tokens > 0").join(leaf, LEAF)
    copies = F.col("epochs") + F.when(F.expr(position(mix, "epochs")) <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("bigint")).filter("copies > 0")


def oracle_sql(mix: Mix = Mix()) -> str:
    """The rows of ``mixed`` in SQL for another engine, with one running sum per leaf."""

    def dealt(name: str, source: str, parent: str, order: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""{name}1 AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cc,
  coalesce(sum(w) OVER ({by} ORDER BY cap / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cw, (sum(w) OVER ({by}))::BIGINT AS tw FROM {source} WHERE w > 0),
{name}2 AS (SELECT *, cap * (tw - cw) <= w * (parent_budget - cc) AS filled FROM {name}1),
{name}3 AS (SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by}), 0)::BIGINT AS fc, coalesce(sum(CASE WHEN filled THEN w END) OVER ({by}), 0)::BIGINT AS fw FROM {name}2),
{name} AS (SELECT *, CASE WHEN filled THEN cap ELSE least(cap, (w * (parent_budget - fc)) // (tw - fw)) END AS budget FROM {name}3)"""

    return f"""
WITH t AS (SELECT doc_id, {domain_sql(mix)} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {mix.epochs})::BIGINT AS cap FROM t GROUP BY ALL),
a0 AS (SELECT domain, cap, {weight_sql("domain", mix.domain)} AS w, (SELECT (sum(tokens)::BIGINT * {mix.percent}) // 100 FROM leaves) AS parent_budget FROM (SELECT domain, sum(cap)::BIGINT AS cap FROM leaves GROUP BY domain)),
{dealt("a", "a0", "", "domain")},
b0 AS (SELECT x.domain, language, x.cap, {weight_sql("language", mix.language)} AS w, budget AS parent_budget FROM (SELECT domain, language, sum(cap)::BIGINT AS cap FROM leaves GROUP BY domain, language) x JOIN a ON x.domain = a.domain),
{dealt("b", "b0", "domain", "language")},
c0 AS (SELECT x.domain, x.language, origin, tokens, x.cap, {weight_sql("origin", mix.source)} AS w, budget AS parent_budget FROM leaves x JOIN b ON x.domain = b.domain AND x.language = b.language),
{dealt("c", "c0", "domain, language", "origin")},
l AS (SELECT domain, language, origin, budget // tokens AS epochs, budget % tokens AS rest FROM c WHERE tokens > 0),
h AS (SELECT t.*, epochs, rest, CAST('0x' || substr(md5('{mix.seed}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS BIGINT) AS h FROM t JOIN l ON t.domain = l.domain AND t.language = l.language AND t.origin = l.origin WHERE n_tokens > 0),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM h),
d AS (SELECT doc_id, domain, language, origin, n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT * FROM d WHERE copies > 0"""
