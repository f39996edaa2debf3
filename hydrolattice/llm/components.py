"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an undirected edge table reaches, itself included.

    Alternates large-star and small-star steps until the edges stay as they are, which takes a number of rounds that
    grows with the logarithm of the longest path. Each step shuffles narrow edge rows, takes a minimum per node with
    partial aggregation and never gathers a node's neighbours; each round is written to the shared folder. Rows with a
    missing end are no edges. An empty table gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    now = stored(
        edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges",
    )
    nodes = now
    now = now.where("u <> v")
    state = None
    while True:
        new = stored(_small_star(_large_star(now)), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state, now = mark, new
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(new.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _joined_minimum(pairs: DataFrame) -> DataFrame:
    """Each (u, v) beside m, the smallest of u and all its v. The minima are a table of their own, so Spark broadcasts them
    while they are small and otherwise splits a hub's edges."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "minima")
    return pairs.join(least, F.col("u") == F.col("w"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _joined_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    linked = _joined_minimum(edges)
    moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(linked.select("u", F.col("m").alias("v"))).distinct()
