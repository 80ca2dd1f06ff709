"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Points each neighbour ``b`` of a node ``a`` (and the node) at the
    smallest of them all."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = pairs.join(low, "a")
    out = joined.select(F.col("b").alias("x"), "low").unionByName(low.select(F.col("a").alias("x"), "low"))
    return scratch.write(out.where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the smallest node
    it is connected with.  Alternates large and small stars; a round halves the
    distance to the smallest node, and each half round is written down."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "0")
    digest = (F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.col("b").cast("decimal(38,0)")))
    step, before = 0, None
    while (state := tuple(now.agg(*digest).first())) != before:
        before = state
        # Large star: the larger neighbours of a node go to its smallest one.
        every = _both_ways(now)
        low = every.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = scratch.write(every.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                              .distinct(), f"{step}-large")
        # Small star: the smaller neighbours of a node, and the node, to the smallest.
        now = _stars(large, scratch, f"{step + 1}")
        scratch.drop(f"{step}-large", f"{step}")
        step += 1
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
