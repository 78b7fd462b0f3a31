"""Connected components of an edge table, by alternating large and small stars. Nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that can be reached, for each node in an edge with another.

    Each round is a few aggregations and joins and ends in a written table. A node's edges are never gathered in one task:
    minima are aggregated before the shuffle, and the join back is an ordinary one, which Spark splits where it is skewed.
    """
    edges = common.durable(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, edges = edges, common.durable(small.select("e.a", "e.b").filter("a != b").distinct())
        common.release(last)
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
