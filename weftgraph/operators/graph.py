"""Property graphs as edge tables: inference, traversal, distances, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DECAY, DEFAULT_EDGE_WEIGHT, EDGE_WEIGHTS
from ..tables import stored


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select("source", "target", *rest).unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest))


def causal_edges(catalog: DataFrame) -> DataFrame:
    """source, target, relation and via: LEADS_TO from a producer of a state to each consumer, REQUIRES back; the state first produced wins. catalog: entity_id, pos, preconditions, postconditions."""
    made = catalog.select(F.col("entity_id").alias("p"), "pos", F.posexplode("postconditions").alias("at", "state"))
    rank = F.min(F.struct("pos", "at")).over(Window.partitionBy("state"))
    made = made.withColumn("first", rank)
    used = catalog.select(F.col("entity_id").alias("c"), F.explode("preconditions").alias("state")).filter(~F.col("state").startswith("NOT "))
    met = made.join(used, "state").filter("p <> c").groupBy("p", "c").agg(F.min_by("state", F.struct("first", "state")).alias("via"))
    forth = met.select(F.col("p").alias("source"), F.col("c").alias("target"), F.lit("LEADS_TO").alias("relation"), "via")
    return forth.unionByName(met.select(F.col("c").alias("source"), F.col("p").alias("target"), F.lit("REQUIRES").alias("relation"), "via"))


def merged_edges(*stages: DataFrame) -> DataFrame:
    """Edges of several stages under one another with the stage's number; columns that one lacks are null."""
    out = None
    for k, edges in enumerate(stages):
        own = edges.withColumn("stage", F.lit(k).cast("long"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def strongest(edges: DataFrame) -> DataFrame:
    """Undirected edges, each once, with the largest score."""
    return edges.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("score").alias("score"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """node and hop: nodes within so many undirected hops of the seeds (node), at their least hop."""
    ways = stored(both_ways(edges.select("source", "target")).distinct())
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long"))
    front = reached
    for k in range(1, depth + 1):
        step = front.join(ways, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = stored(step.join(reached, "node", "left_anti").withColumn("hop", F.lit(k).cast("long")))
        reached = reached.unionByName(front)
    return reached


def hop_edges(edges: DataFrame, reached: DataFrame, depth: int = 2) -> DataFrame:
    """Edges of every node that was expanded (hop < depth): one between two such nodes comes twice."""
    inner = reached.filter(F.col("hop") < depth).select("node")
    return edges.join(inner, F.col("source") == F.col("node")).drop("node").unionByName(edges.join(inner, F.col("target") == F.col("node")).filter("source <> target").drop("node"))


def edge_weight(relation: Column) -> Column:
    out = F.lit(DEFAULT_EDGE_WEIGHT)
    for name, weight in EDGE_WEIGHTS.items():
        out = F.when(relation == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def distances(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """node and distance from the nearest goal (node), undirected, by relation weights; relations of no weight aren't walked. Only nodes that came nearer in a round are expanded in the next."""
    ways = both_ways(edges.select("source", "target", "relation")).withColumn("w", edge_weight(F.col("relation"))).filter("w IS NOT NULL").groupBy("source", "target").agg(F.min("w").alias("w"))
    ways = stored(ways)
    # fronts are kept as they are; a node's distance is the least of all fronts, merged when they have become many
    best = stored(goals.select("node").distinct().withColumn("distance", F.lit(0).cast("long")))
    front, fronts = best, 0
    while not front.isEmpty():
        step = front.join(ways, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        known = best.join(step.select("node"), "node", "left_semi").groupBy("node").agg(F.min("distance").alias("distance"))
        front = stored(step.join(known, "node", "left").filter("distance IS NULL OR new < distance").select("node", F.col("new").alias("distance")))
        best, fronts = best.unionByName(front), fronts + 1
        if fronts % 8 == 0:
            best = stored(best.groupBy("node").agg(F.min("distance").alias("distance")))
    return stored(best.groupBy("node").agg(F.min("distance").alias("distance")))


def arriving_relations(edges: DataFrame, found: DataFrame) -> DataFrame:
    """node, distance and via: the relation of the last edge of a shortest path, the least (distance before, node before, relation) among equals."""
    ways = both_ways(edges.select("source", "target", "relation")).withColumn("w", edge_weight(F.col("relation"))).filter("w IS NOT NULL")
    before = found.select(F.col("node").alias("source"), F.col("distance").alias("d0"))
    arrived = ways.join(before, "source").join(found.select(F.col("node").alias("target"), "distance"), "target").filter("d0 + w = distance")
    last = arrived.groupBy(F.col("target").alias("node"), "distance").agg(F.min_by("relation", F.struct("d0", "source", "relation")).alias("via"))
    return found.join(last.select("node", "via"), "node", "left")


def propagated(seeds: DataFrame, edges: DataFrame, decay: float = DECAY) -> DataFrame:
    """key, node and score: seed scores (key, node, score), and what one hop adds: score times edge score times decay over log2(2 + degree) of the node that it reaches, the largest for a node; never less than its own."""
    ways = both_ways(edges.select("source", "target", F.coalesce("score", F.lit(0.0)).alias("edge")))
    degree = ways.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("degree"))
    sent = seeds.join(ways, F.col("node") == F.col("source")).join(degree, "target").select("key", F.col("target").alias("node"), (F.col("score") * F.col("edge") * decay / F.log2(F.col("degree") + 2)).alias("score")).filter("score > 0")
    return seeds.select("key", "node", "score").unionByName(sent).groupBy("key", "node").agg(F.max("score").alias("score"))
