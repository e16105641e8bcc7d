"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedtrace.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node of a link; nodes with the same root are connected.

    In each round every node hooks onto its smallest neighbour (if smaller than itself) and the links are drawn anew
    between the nodes that remain. With node numbers that are hashes a round removes a constant share of them, so the
    number of rounds grows with the logarithm of the largest component. Minima are combined before the shuffle, and
    joins read written tables, so a node with very many links is split over tasks.
    """
    edges = cut_lineage(links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    nodes = cut_lineage(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to")))
        left = edges.join(hook, F.col("a") == F.col("v")).select(F.col("to").alias("a"), "b")
        drawn = left.join(hook, F.col("b") == F.col("v")).select("a", F.col("to").alias("b")).filter("a <> b")
        edges = cut_lineage(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        nodes = cut_lineage(nodes.join(hook, F.col("root") == F.col("v"), "left").select("node", F.coalesce("to", "root").alias("root")))
    return nodes
