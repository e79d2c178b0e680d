"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import cut_lineage


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df with its key as a new expression: an aggregate by key is then dealt again for a join, as the
    other side is, and adaptive execution can split a key with very many rows on that side."""
    return df.withColumn(key, F.col(key) + 0)


def _unsettled(pairs: DataFrame) -> bool:
    """Whether a node of (a, b) has two parents, or is both a child and a parent."""
    roles = pairs.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        pairs.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    both = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return both.agg(F.max((F.col("child") > 1) | (F.col("child") > 0) & (F.col("parent") > 0))).first()[0] or False


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the least node it reaches.

    Every round links nodes to smaller ones and is written, until each has its component as parent.
    """
    # a > b from here on
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = cut_lineage(down.distinct())
    while _unsettled(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = dealt_anew(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "a")
        large = cut_lineage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        least = dealt_anew(large.groupBy("a").agg(F.min("b").alias("low")), "a")
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        pairs = cut_lineage(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct())
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
