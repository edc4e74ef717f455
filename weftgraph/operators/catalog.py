"""A slug catalogue: entities, edges and profiles of lessons that name skills and prerequisites.

lessons: chunk_id, title, text, skills and prerequisites (arrays of names). Names become ids by the slug rule, so names that
differ in case or signs only are one entity.

Defined cases: a null array is empty, a null name names nothing; an entity is in the catalogue if it is known beforehand or
named at least MIN_MENTIONS times, repeats counted; rows with an end outside the catalogue give no edge; an empty table gives
an empty catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EDGE_SCORES, MIN_MENTIONS, TOP_KEYWORDS
from ..functions import words
from ..functions.text import slug
from .graph import strongest


def _names(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def named(lessons: DataFrame) -> DataFrame:
    """chunk_id, at, name, entity_id and kind ('skill' or 'prerequisite') of each name in a lesson, repeats kept."""
    entry = lambda kind: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"))
    both = F.concat(F.transform(_names("skills"), entry("skill")), F.transform(_names("prerequisites"), entry("prerequisite")))
    rows = lessons.select("chunk_id", F.posexplode(both).alias("at", "e")).filter("e.name IS NOT NULL")
    return rows.select("chunk_id", "at", "e.name", slug(F.col("e.name")).alias("entity_id"), "e.kind")


def entity_catalog(names: DataFrame, known: DataFrame | None = None, least: int = MIN_MENTIONS) -> DataFrame:
    """entity_id, name (the first in order) and mentions of entities that are known (entity_id) or named often enough."""
    counted = names.groupBy("entity_id").agg(F.min("name").alias("name"), F.count("*").alias("mentions"))
    if known is None:
        return counted.filter(F.col("mentions") >= least)
    sure = known.select("entity_id", F.lit(True).alias("_sure")).distinct()
    return counted.join(sure, "entity_id", "left").filter((F.col("mentions") >= least) | F.col("_sure")).drop("_sure")


def catalog_edges(skill_edges: DataFrame, names: DataFrame, catalog: DataFrame) -> DataFrame:
    """source, target and score of undirected edges, each with its best score: stated ones (source, target: names; relation), and inferred ones between each skill of a lesson and its prerequisites."""
    score = F.when(F.col("relation") == "requires", EDGE_SCORES["requires"]).otherwise(EDGE_SCORES["other"])
    stated = skill_edges.select(slug(F.col("source")).alias("source"), slug(F.col("target")).alias("target"), score.alias("score"))
    side = lambda kind, x: names.filter(F.col("kind") == kind).select("chunk_id", F.col("entity_id").alias(x)).distinct()
    inferred = side("skill", "source").join(side("prerequisite", "target"), "chunk_id").filter("source <> target").select("source", "target").distinct().withColumn("score", F.lit(EDGE_SCORES["inferred"]))
    # ends are looked up once for each pair, not for each lesson that infers it
    pairs = strongest(stated.unionByName(inferred))
    held = lambda x: catalog.select(F.col("entity_id").alias(x))
    return pairs.join(held("source"), "source", "left_semi").join(held("target"), "target", "left_semi").select("source", "target", "score")


def co_skills(names: DataFrame, catalog: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """entity_id, skill, n and rank: the skills that most often stand in an entity's lessons, a lesson once for each mention of the entity; names break ties. Work is names times skills of each lesson."""
    entities = names.join(catalog.select("entity_id"), "entity_id", "left_semi").groupBy("chunk_id", "entity_id").agg(F.count("*").alias("times"))
    skills = names.filter("kind = 'skill'").groupBy("chunk_id", F.col("entity_id").alias("_other"), F.col("name").alias("skill")).agg(F.count("*").alias("again"))
    counted = entities.join(skills, "chunk_id").filter("entity_id <> _other").groupBy("entity_id", "skill").agg(F.sum(F.col("times") * F.col("again")).alias("n"))
    order = Window.partitionBy("entity_id").orderBy(F.desc("n"), "skill")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def lesson_keywords(lessons: DataFrame, names: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """entity_id, token, n and rank: the commonest tokens in the texts of an entity's lessons. names: as named tells them of the lessons. Tasks count the tokens of all lessons that name the same entities, so neither texts nor their tokens meet names in a join."""
    ids = F.array_sort(F.transform(F.array_compact(F.concat(_names("skills"), _names("prerequisites"))), lambda n: slug(n)))
    told = words.counts_by_ids(lessons.select(ids.alias("ids"), F.lit(0).cast("long").alias("pos"), "text"), "long")
    counted = told.select(F.explode("ids").alias("entity_id"), "token", "n").groupBy("entity_id", "token").agg(F.sum("n").alias("n")).join(catalog.select("entity_id"), "entity_id", "left_semi")
    order = Window.partitionBy("entity_id").orderBy(F.desc("n"), "token")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
