"""Markdown with a YAML head: scans, spans and exports; JSON, JSON lines and edge files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import RELATIONS
from ..operators.mentions import last_wins

ENTITY = "struct<id:string,name:string,type:string,aliases:array<string>,preconditions:array<string>,postconditions:array<string>,related_skills:array<string>>"
CHUNK = "struct<id:string,context:string,tags:array<string>,entities:array<string>,created_at:string,version:int,type:string,priority:string,dependencies:array<string>,state_refs:array<string>>"
SKILL = "name string, description string, preconditions array<string>, postconditions array<string>, related_skills array<string>, cost string, idempotent boolean"
HEAD = r"(?s)\A---[^\n]*\n(.*?)(?:(?<=\n)|\A)[ \t]*---[ \t]*(?:\n|\z)"


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """path and text of each file under a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_head(docs: DataFrame) -> DataFrame:
    """docs with head (YAML text, null without one) and body."""
    found = F.col("text").rlike(HEAD)
    head = F.when(found, F.regexp_extract("text", HEAD, 1))
    return docs.withColumn("head", head).withColumn("body", F.when(found, F.regexp_replace("text", F.lit(HEAD), F.lit(""))).otherwise(F.col("text")))


@F.pandas_udf(StringType())
def yaml_json(heads: pd.Series) -> pd.Series:
    """YAML as JSON; null where it doesn't parse or isn't a mapping. Spark has no YAML reader."""
    import yaml

    def one(text: str | None) -> str | None:
        try:
            value = yaml.safe_load(text) if text is not None else None
        except yaml.YAMLError:
            return None
        return json.dumps(value, default=str) if isinstance(value, dict) else None

    return heads.map(one)


def spans(docs: DataFrame, body: str = "body") -> DataFrame:
    """path, id, content and pos of the tagged spans of each body; of equal ids the last counts."""
    pattern = r"(?is)<Chunk\s+id=[\"']([^\"']+)[\"']>(.*?)</Chunk>"
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), 1).alias("id"), F.regexp_extract_all(body, F.lit(pattern), 2).alias("content"))
    rows = docs.select("path", F.posexplode(pairs).alias("pos", "s")).select("path", "pos", F.col("s.id").alias("id"), F.trim(F.regexp_replace("s.content", r"^\s+|\s+$", "")).alias("content"))
    keyed = rows.withColumn("_key", F.struct("path", "id"))
    return last_wins(keyed, "_key", "pos").drop("_key")


def export(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks joined with their spans, without those that have no id or content, and entities, of equal ids the first."""
    parsed = split_head(docs).withColumn("data", F.from_json(yaml_json("head"), f"chunks array<{CHUNK}>, entities array<{ENTITY}>"))
    defined = parsed.select("path", F.posexplode("data.chunks").alias("pos", "c")).select("path", "pos", "c.*").filter("id <> ''")
    chunks = defined.join(spans(parsed).select("path", "id", "content"), ["path", "id"]).filter("content <> ''").withColumn("source", F.col("path"))
    entities = parsed.select("path", F.posexplode("data.entities").alias("pos", "e")).select("path", "pos", "e.*")
    first = entities.groupBy("id").agg(F.min_by(F.struct(*[c for c in entities.columns if c != "id"]), F.struct("path", "pos")).alias("e"))
    return chunks, first.select("id", "e.*")


def read_skills(spark: SparkSession, path: str) -> DataFrame:
    """Skills of all SKILL.md files under a folder, in path order, with pos and source_path; those without a name are left out."""
    parsed = split_head(read_markdown(spark, path, "SKILL.md")).select("path", F.from_json(yaml_json("head"), SKILL).alias("s")).filter("s.name IS NOT NULL")
    from pyspark.sql import Window

    # a catalogue is some hundred files; its order is one small sort
    rows = parsed.select("s.*", F.col("path").alias("source_path")).withColumn("pos", (F.row_number().over(Window.orderBy("source_path")) - 1).cast("long"))
    for c in ("preconditions", "postconditions", "related_skills"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return rows.withColumn("cost", F.coalesce("cost", F.lit("medium"))).withColumn("idempotent", F.coalesce("idempotent", F.lit(False)))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_extra_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON array; those without both ends are left out, an unknown relation is an error."""
    rows = spark.read.schema("source string, target string, relation string, score double").option("multiLine", True).json(path).filter("source IS NOT NULL AND target IS NOT NULL")
    relation = F.coalesce("relation", F.lit("SIMILAR"))
    return rows.withColumn("relation", F.when(relation.isin(*RELATIONS), relation).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), relation)).cast("string")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read_queries(spark: SparkSession, text: str) -> DataFrame:
    """Benchmark queries of a YAML text."""
    import yaml

    rows: Iterator = (yaml.safe_load(text) or {}).get("queries", [])
    return spark.createDataFrame([(q["id"], q["query"], q.get("expected_entities", [])) for q in rows], "id string, text string, expected array<string>")
