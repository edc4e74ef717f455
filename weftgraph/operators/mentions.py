"""Entity mentions, references and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_CONTEXTS, TOP_KEYWORDS
from ..functions.text import tokens


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))).filter("_n = 1").drop("_n")


def mentions(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """chunk_id, chunk_pos, ref_pos and entity_id of each reference to a known entity; repeats stay. chunks: chunk_id, chunk_pos, entities."""
    refs = chunks.select("chunk_id", "chunk_pos", F.posexplode("entities").alias("ref_pos", "entity_id"))
    return refs.join(catalog.select("entity_id"), "entity_id", "left_semi")


def dangling(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """References to unknown entities, each once."""
    return chunks.select(F.explode("entities").alias("entity_id")).distinct().join(catalog.select("entity_id"), "entity_id", "left_anti")


def co_mentions(found: DataFrame) -> DataFrame:
    """a < b and n, the number of chunks that mention both. found: chunk_id, entity_id."""
    once = found.select("chunk_id", "entity_id").distinct()
    a, b = once.withColumnRenamed("entity_id", "a"), once.withColumnRenamed("entity_id", "b")
    return a.join(b, "chunk_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def first_contexts(found: DataFrame, most: int = MAX_CONTEXTS) -> DataFrame:
    """The first contexts of each entity in mention order: entity_id, contexts (joined by a bar) and mention_count. found: entity_id, position, context."""
    if most < 1:
        raise ValueError("most must be 1 or more")
    # ranks are cut inside each task first, so a frequent entity never gathers in one
    order = Window.partitionBy("entity_id").orderBy("position", "context")
    top = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    lists = top.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "context"))), lambda x: x["context"]), "|").alias("contexts"))
    return lists.join(found.groupBy("entity_id").agg(F.count("*").alias("mention_count")), "entity_id")


def keywords(texts: DataFrame, blocked: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """entity_id, token, n and rank: the most counted tokens of each entity's texts, first occurrence first among equals. texts: entity_id, position, text; blocked: entity_id, token."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    exploded = texts.select("entity_id", "position", F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    counted = exploded.groupBy("entity_id", "token").agg(F.count("*").alias("n"), F.min(F.struct("position", "at")).alias("first"))
    left = counted.join(blocked, ["entity_id", "token"], "left_anti")
    order = Window.partitionBy("entity_id").orderBy(F.desc("n"), "first", "token")
    return left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("entity_id", "token", "n", "rank")
