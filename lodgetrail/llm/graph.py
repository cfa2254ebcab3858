"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetrail.session import stage


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` that is no ``a`` itself: the ends are then the roots."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return nodes.where("up > 1 OR (up = 1 AND root = 1)").isEmpty()


def _toward_smallest(edges: DataFrame, only_larger: bool) -> DataFrame:
    """One star step: the neighbours of each ``a`` are linked with the smallest of them and ``a``.

    The smallest are staged, so that the join meets plain shuffles, which Spark splits where a hub is hot.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    least = stage(least.select("a", F.least("a", "least").alias("least")), "star")
    met = edges.join(least, "a")
    if only_larger:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    rows = met.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rows.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of the links ``a``, ``b``.

    Direction, repeats and self-links don't matter; a node with self-links only is left out. Each step is written to
    the shared folder. The number of steps grows with the logarithm of the longest chain.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stage(_toward_smallest(both, only_larger=True), "large-star")
        edges = stage(_toward_smallest(large, only_larger=False).distinct(), "small-star")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
