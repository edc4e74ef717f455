"""Connected components of a table of links, by minimum labels and pointer jumping. No link or label comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of links (a, b). Each round contracts links onto the roots found so far."""
    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None  # node, component
    while not edges.isEmpty():
        # each node points to its smallest neighbour below it; chains of pointers are then halved until all point at roots
        parent = kept(edges.groupBy("a").agg(F.min("b").alias("b")), "parents")
        while True:
            jumped = kept(parent.alias("p").join(parent.alias("q"), F.col("p.b") == F.col("q.a"), "left").select(F.col("p.a"), F.coalesce("q.b", "p.b").alias("b"), F.col("q.b").isNotNull().alias("moved")), "jumps")
            parent = jumped.select("a", "b")
            if jumped.filter("moved").isEmpty():
                break
        to = parent.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if labels is None:
            labels = to.select("node", F.col("root").alias("component"))
        else:
            labels = labels.join(to, F.col("component") == to["node"], "left").select(labels["node"], F.coalesce("root", "component").alias("component")).unionByName(to.join(labels.select("node"), "node", "left_anti").select("node", F.col("root").alias("component")))
        labels = kept(labels, "labels")
        left = edges.join(to.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(to.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
        left = left.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b")
        edges = kept(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = labels.select(F.col("component").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(roots.select("node", F.col("node").alias("component")))
