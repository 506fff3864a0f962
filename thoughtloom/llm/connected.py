"""Connected components of an undirected graph given as rows (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge; the root is the smallest node reachable.

    Rounds of large-star and small-star: nodes are linked to the smallest node in
    their neighbourhood until all components are stars. The smallest neighbour is a
    partial aggregate, so a node with very many neighbours is no single task; each
    round is written to the shared folder and the one before removed.
    """
    current = materialise(_distinct(edges.where(F.col("a") != F.col("b"))))
    while not _are_stars(current):
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        following = materialise(_star(_star(both, True), False).distinct())
        discard(current)
        current = following
    roots = current.select(F.col("b").alias("a"), "b").distinct()
    return current.select("a", "b").union(roots).toDF("node", "root")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return several.isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def _distinct(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b"))
