"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node of its component.

    Self links are allowed. Every round is a few equi-joins over link rows; only counts reach the driver. The rounds end: they are
    about the logarithm of the longest shortest path, each table of a round goes as soon as the next is written. Without a
    ``scratch`` the last one stays until ``release``.
    """
    if scratch is None:
        with Scratch(links.sparkSession) as own:
            found = components(links, a, b, own)
            return own.keep(own.write(found, "components"))
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.write(edges, "links")
    while True:
        # Done when every node points at one root: no u twice, and no v that is itself a u.
        tops = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        chained = edges.join(tops.select(F.col("u").alias("v")), "v", "left_semi")
        if tops.where("n > 1").isEmpty() and chained.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below has exchanges of its own and a node with very many links can be split.
        lowest = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.write(large, "large-star")
        scratch.drop(edges, lowest)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.write(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
        scratch.drop(large)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
