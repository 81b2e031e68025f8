"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depthlens.session import write_table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): every node of the undirected ``edges`` (a, b) with the smallest node it is connected to.

    Each step hangs nodes below smaller ones without losing connections, until every edge joins a node to the smallest
    of its component.  Minima are pre-aggregated and joins are plain ones, so a node with very many edges is split.
    Empty input gives an empty result; repeated edges and loops do no harm.
    """
    edges = write_table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node move to the smallest of its neighbourhood
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = write_table(
            both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct(), "edges"
        )
        # small star: a node and its neighbours below move to the smallest of those
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        edges = write_table(
            joined.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
            .unionByName(least.select(F.col("m").alias("a"), "b")).distinct(),
            "edges",
        )
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Whether every upper end hangs below one node only, and that node below none."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(
        edges.select(F.col("a").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    )
    tied = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return tied.filter("above > 1 OR above = 1 AND below = 1").isEmpty()
