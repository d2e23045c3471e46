"""Connected components of a link table, by alternating large-star and small-star steps; every step is a written table.

The stars of nodes with many links are not joined by the node, which would put all of them in one task: the least neighbours of such
nodes are broadcast instead. A node is one of them from HOT links on and from a SHARE-th of all links on, so there are at most
2 * SHARE of them, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import dropped, staged


HOT, SHARE = 100_000, 1_000


def _with_least(pairs: DataFrame, degrees: DataFrame, links: int, hot: int) -> DataFrame:
    """pairs (u, v) with their u's m. degrees: u, m, n, a row for each u, n its number of pairs; links: of the whole table."""
    bound = max(hot, links // SHARE)
    if links < bound:  # no node has as many
        return pairs.join(degrees.select("u", "m"), "u")
    many = staged(degrees.where(F.col("n") >= bound).select("u", "m"), "hot")
    if many.isEmpty():
        return pairs.join(degrees.select("u", "m"), "u")
    few = pairs.join(F.broadcast(many.select("u")), "u", "left_anti").join(degrees.where(F.col("n") < bound).select("u", "m"), "u")
    return pairs.join(F.broadcast(many), "u").unionByName(few)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """links (a, b) of integers; returns (node, root) for every node with a link to another, root the least of its component."""
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = staged(pairs, "links")
    state = _state(now)
    while state[0]:
        # large star: a node's larger neighbours move to its least one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = _with_least(both, least, state[0], hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        small = _with_least(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), state[0], hot)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = staged(moved, "links")
        dropped(now)
        now = after
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
