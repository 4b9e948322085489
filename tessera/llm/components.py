"""Connected components of a table of links, by alternating large and small stars.

Every round rewrites the links so that each node points at a smaller node it can reach; the rounds end when the links are
stars, which is tested before each round, after about the logarithm of the longest path. A round is grouped minima,
combined before they are shuffled, and joins that AQE can split, so a node with very many links is no single task. Links
are written to the shared folder after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, written


def _stars(links: DataFrame) -> DataFrame:
    """Large star then small star of links (a, b) with a > b; again distinct links with a > b."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(shuffled(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(large.where("a > b"), "stars")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    near = large.join(shuffled(least), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether each node of distinct ``links`` that points at a smaller one points at that one alone, and none at it."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the root is the smallest node of its component."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    while not _all_stars(links):
        links = written(_stars(links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
