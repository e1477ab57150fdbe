"""Connected components of a graph that only the executors hold: alternating large and small stars over settled edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(pairs: DataFrame, keep, own: bool) -> DataFrame:
    """pairs u, v: joins the neighbours of each u to the least of them (u included).

    The minima are settled, so that the join deals out both sides anew and Spark can split a node of very many neighbours.
    """
    least = settle(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), "least")
    out = pairs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if own:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (long) -> node, root: every node of an edge and the smallest node it reaches, settled.

    Each round writes its edges to the shared folder; the loop ends when all edges are rays of stars, that is when no node is
    both the larger end of an edge and the smaller end of another. No edges: no rows.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() or not edges.groupBy("a").count().where("count > 1").isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = settle(_star(both, F.col("v") > F.col("u"), False).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "large")
        edges = settle(_star(large, F.lit(True), True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
    return settle(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "components")
