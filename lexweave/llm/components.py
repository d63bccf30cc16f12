"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sweep


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rows_a_part: int = 100_000) -> DataFrame:
    """(id, root) of every id in `links` (u, v): root is the least id that can be reached.

    Each round only joins and takes minima. The minima are tables of their own, so both sides of a join are
    shuffled for it and Spark can split the links of a node that has very many. It ends when no link changes,
    after a number of rounds that grows with the logarithm of the longest path. Few links are kept in few partitions, so that a
    round costs no more files and tasks than they need; the number grows with the links."""
    edges = checkpointed(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = _digest(edges)
    while True:
        parts = 1 + before[0] // rows_a_part
        edges = edges.coalesce(parts)
        # Large star: neighbours above a node are tied to the least of its neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").coalesce(parts).distinct().coalesce(parts)
        # Small star: a node and its neighbours below are tied to the least of them.
        large = checkpointed(large)
        low = checkpointed(large.groupBy("v").agg(F.min("u").alias("m")).coalesce(parts))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").coalesce(parts)
        edges = checkpointed(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct().coalesce(parts))
        after = _digest(edges)
        del both, least, large, low, small
        sweep(edges.sparkSession)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).union(edges.select("u", "u").distinct().toDF("id", "root"))
