"""Entity-aware reranking: texts for retrieval, seeds among entities, and the blend of three components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BLEND, DENSITY_CAP, SEED_FLOOR, SEEDS
from .graph import both_ways, propagated


def joined_parts(*parts: Column) -> Column:
    """Lines of those parts that hold something."""
    return F.concat_ws("\n", *[F.when(F.coalesce(p, F.lit("")) != "", p) for p in parts])


def chunk_texts(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """id and text of chunks (chunk_id, context, content, tags, entities): context, content, tags, and a line with the name of each entity in order. names: entity_id, name."""
    refs = chunks.select("chunk_id", F.posexplode("entities").alias("at", "entity_id")).join(names.filter("name <> ''"), "entity_id")
    lists = refs.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "\n").alias("named"))
    text = joined_parts(F.col("context"), F.col("content"), F.array_join("tags", " "), F.col("named"))
    return chunks.join(lists, "chunk_id", "left").select(F.col("chunk_id").alias("id"), text.alias("text"))


def entity_texts(profiles: DataFrame) -> DataFrame:
    """id and text of profiles: name, type, aliases, tags, keywords, contexts, related names and representation, those that there are."""
    lists = [F.array_join(c, " ") for c in ("aliases", "tags", "keywords", "contexts", "related")]
    return profiles.select("id", joined_parts(F.col("name"), F.col("type"), *lists, F.col("representation")).alias("text"))


def seeds(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """key, node and score of the best few entities of each key, ties by node, if over the floor; damped by log2(2 + degree). scores: key, node, score."""
    first = Window.partitionBy("key").orderBy(F.desc(F.round("score", 9)), "node")
    best = scores.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") <= SEEDS) & (F.col("score") > SEED_FLOOR))
    degree = both_ways(edges.select("source", "target")).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    return best.join(degree, "node", "left").select("key", "node", (F.col("score") / F.log2(F.coalesce("degree", F.lit(0)) + 2)).alias("score"))


def reranked(base: DataFrame, entity_scores: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """key, chunk_id and score: a share of the base score over its largest, of what the chunk's entities cover over the largest entity score, and of how many of them are reached, up to a few. base: key, chunk_id, score; entity_scores: key, node, score; refs: chunk_id and node, repeats kept. Chunks that score nothing are left out, a largest score of 0 counts as 1."""
    reached = propagated(seeds(entity_scores, edges), edges)
    linked = refs.groupBy("chunk_id").agg(F.count("*").alias("linked"))
    cover = refs.join(reached, "node").groupBy("key", "chunk_id").agg(F.sum("score").alias("sum"), F.count("*").alias("density"))
    cover = cover.join(linked, "chunk_id").select("key", "chunk_id", (F.col("sum") / F.sqrt("linked")).alias("cover"), "density")
    met = base.select("key", "chunk_id", "score").join(cover, ["key", "chunk_id"], "full")
    largest = lambda df, name: df.groupBy("key").agg(F.max("score").alias(name))
    met = met.join(largest(base, "top"), "key", "left").join(largest(reached, "most"), "key", "left")
    over = lambda c, by: F.coalesce(c, F.lit(0.0)) / F.coalesce(F.nullif(F.col(by), F.lit(0.0)), F.lit(1.0))
    share = F.least(F.coalesce("density", F.lit(0)), F.lit(DENSITY_CAP)) / F.lit(float(DENSITY_CAP))
    return met.select("key", "chunk_id", (F.lit(BLEND[0]) * over("score", "top") + F.lit(BLEND[1]) * over("cover", "most") + F.lit(BLEND[2]) * share).alias("score"))
