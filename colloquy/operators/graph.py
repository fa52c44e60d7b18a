"""Connected components of a graph of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; the component is its smallest node.

    Each round points the larger neighbours of every node, then the smaller
    ones, to its smallest neighbour; the number of rounds grows with the
    logarithm of the longest path. Rounds are cut by durable tables, and only
    a checksum of the links reaches the driver. NULL ends and self links give
    no link (a self link still gives its node); an empty input gives no rows.
    """
    own = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    current = durable(own.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    checksum = None
    while True:
        both = current.union(current.select(F.col("b"), F.col("a"))).distinct()
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        lone = current.where("a = b")
        large = large.union(lone).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        # The node itself also points to its smallest neighbour.
        small = large.join(lowest, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).where("x > y").union(lowest.select("a", "low"))
        current = durable(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == checksum:
            break
        checksum = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.union(roots).groupBy("node").agg(F.min("component").alias("component"))
