"""Connected components of a link table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.staging import stage


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest among them and the node.

    With ``larger_only`` the larger neighbours are tied, else the smaller ones and the node. The
    minimum is a combining aggregate joined back, so a node with very many links is never gathered
    in one task.
    """
    if larger_only:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m"))
    low = low.withColumn("m", F.least("m", "a"))
    joined = near.join(low, "a")
    if larger_only:
        tied = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Staged ``node, component`` of every node with a link to another; ``component`` is the
    smallest node that its links reach. Rounds grow with the logarithm of the longest path."""
    edges = stage(
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        edges = stage(_star(_star(edges, True), False), "links")
        now = tuple(edges.agg(
            F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    labels = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("a"), F.col("b").alias("component")).distinct()
    return stage(labels.unionByName(roots).groupBy("a").agg(F.min("component").alias("component"))
                 .withColumnRenamed("a", "node"), "components")
