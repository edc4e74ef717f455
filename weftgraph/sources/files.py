"""JSON documents of exports, profiles, graphs, states and runs; reports and other text; and the contextualised Markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import injected_context, word_count
from .markdown import CHUNK, ENTITY

CHUNKS = "chunks array<" + CHUNK.removesuffix(">") + ",content:string,content_path:string,source:string>>"
PROFILE = "struct<id:string,name:string,type:string,aliases:array<string>,mentioned_chunks:array<string>,mention_count:bigint,tags:array<string>,contexts:array<string>,content_excerpts:array<string>,related_entities:array<string>,keywords:array<string>,representation:string>"
STATE = "session_id string, goal string, active_states array<string>, completed_skills array<struct<skill:string,timestamp:string,result:string,summary:string>>, current_subgraph struct<nodes:array<string>,edges:array<struct<source:string,target:string,relation:string>>>, created_at string, updated_at string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents of a declared schema, one row a document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_document(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """What a document is, by its fields, and its rows: ``export`` (entities, with their chunks as a column) where it has a list of chunks, else ``profiles``; neither is an error."""
    doc = read_json(spark, path, f"{CHUNKS}, entities array<{PROFILE}>")
    shape = doc.agg(F.count("chunks").alias("chunks"), F.count("entities").alias("entities")).first()
    if shape["chunks"]:
        return "export", doc
    if not shape["entities"]:
        raise ValueError(f"{path} holds neither a list of chunks nor one of entities")
    return "profiles", doc.select(F.explode("entities").alias("p")).select("p.*")


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and entities of an export; without both lists it is none."""
    doc = read_json(spark, path, f"{CHUNKS}, entities array<{ENTITY}>")
    if doc.filter("chunks IS NULL OR entities IS NULL").count():
        raise ValueError(f"{path} lacks a list of chunks or of entities")
    chunks = doc.select(F.posexplode("chunks").alias("pos", "c")).select("pos", "c.*")
    return chunks, doc.select(F.posexplode("entities").alias("pos", "e")).select("pos", "e.*")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, STATE)


def new_states(goals: DataFrame, now: Column | None = None) -> DataFrame:
    """Fresh session states of goals (goal, seed: active states): ids and times are made, or given for tests by a column session_id and by now."""
    at = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    own = F.col("session_id") if "session_id" in goals.columns else F.expr("uuid()")
    empty = lambda kind: F.array().cast(kind)
    graph = F.struct(empty("array<string>").alias("nodes"), empty("array<struct<source:string,target:string,relation:string>>").alias("edges"))
    return goals.select(own.alias("session_id"), "goal", F.array_distinct("seed").alias("active_states"), empty("array<struct<skill:string,timestamp:string,result:string,summary:string>>").alias("completed_skills"), graph.alias("current_subgraph"), at.alias("created_at"), at.alias("updated_at"))


def write_states(states: DataFrame, path: str, now: Column | None = None) -> None:
    """States as JSON lines, with the time of writing as updated_at. Never over the path they are read from."""
    at = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    states.withColumn("updated_at", at).write.mode("overwrite").json(path)


def one_document(parts: dict[str, DataFrame], pretty: bool = False) -> DataFrame:
    """One row, value: a JSON document with a list of each part's rows in their order. It is one value, as the format has it, and as large as the parts; large results go to write.json or Parquet."""
    out = None
    for name, rows in parts.items():
        order = F.monotonically_increasing_id()
        listed = rows.select(F.struct(order.alias("_n"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r")).alias("x"))
        listed = listed.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias(name))
        out = listed if out is None else out.crossJoin(listed)
    return out.select(F.to_json(F.struct(*parts), {"pretty": "true"} if pretty else {}).alias("value"))


def write_document(parts: dict[str, DataFrame], path: str, pretty: bool = False) -> None:
    one_document(parts, pretty).coalesce(1).write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, more: DataFrame | None = None) -> None:
    """Nodes and edges below a path; more: edges to append. The path must not be the one they are read from."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    (edges if more is None else edges.unionByName(more, allowMissingColumns=True)).write.mode("overwrite").json(f"{path}/edges")


def write_run(history: DataFrame, end: DataFrame, path: str) -> None:
    """A run's steps and its ends."""
    history.write.mode("overwrite").json(f"{path}/history")
    end.withColumn("goal_reached", F.col("reason") == "goal_reached").write.mode("overwrite").json(f"{path}/result")


def retrieval_report(ranked: DataFrame, queries: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """Lines (query_id, line) of a report: for each query its text, its ranked chunks and how many of them are relevant. ranked: query_id, id, rank, score; queries: id, text; relevant: query_id, id."""
    hits = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    row = F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), F.col("id").cast("string"), F.lit(" ("), F.format_number("score", 3), F.lit(")"), F.when(F.col("hit") == 1, " *").otherwise(""))
    told = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("line")))).alias("l"), F.count("hit").alias("found"))
    met = queries.select(F.col("id").alias("query_id"), "text").join(told, "query_id", "left")
    head = F.concat(F.lit("## "), F.col("query_id").cast("string"), F.lit(": "), F.col("text"))
    foot = F.concat(F.lit("recovered "), F.coalesce("found", F.lit(0)).cast("string"), F.lit(f" of {k}"))
    lines = F.concat(F.array(head), F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>")), F.array(foot))
    return met.select("query_id", F.posexplode(lines).alias("at", "line"))


def issue_report(issues: DataFrame, level: str = "diagnose", as_json: bool = False) -> DataFrame:
    """value: issues (doc, rule, severity, subject, message, and suggestion and fix where the level shows them) as text lines or JSON. Levels: diagnose, suggest, fix; each shows what the one before shows."""
    levels = ("diagnose", "suggest", "fix")
    if level not in levels:
        raise ValueError(f"level must be one of {levels}")
    more = [c for c, least in (("suggestion", 1), ("fix", 2)) if levels.index(level) >= least and c in issues.columns]
    if as_json:
        return issues.select(F.to_json(F.struct("doc", "rule", "severity", "subject", "message", *more)).alias("value"))
    said = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {c}: "), F.col(c).cast("string") if c != "fix" else F.to_json(c))) for c in more]
    return issues.select(F.concat_ws("\n", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("doc"), F.lit(" "), F.coalesce("subject", F.lit("")), F.lit(" "), F.col("message")), *said).alias("value"))


def dry_context(chunk_id: Column) -> Column:
    """The context of a chunk where no model is called."""
    return F.concat(F.lit("[DRY RUN] Context for "), chunk_id)


def situated(chunks: DataFrame, model: Callable[[str, str], tuple[str, int, int, int]] | None = None) -> DataFrame:
    """chunks (doc, id, content, text: the whole document) with context, and the tokens that the call read, wrote and had cached. model: a function of document and chunk; without one the context is the dry run's, and no tokens are used."""
    if model is None:
        zero = F.lit(0).cast("long")
        return chunks.select("doc", "id", dry_context(F.col("id")).alias("context"), zero.alias("read"), zero.alias("written"), zero.alias("cached"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [model(t, c) for t, c in zip(rows["text"], rows["content"], strict=True)]
            yield pd.DataFrame({"doc": rows["doc"], "id": rows["id"], **{n: [g[k] for g in got] for k, n in enumerate(("context", "read", "written", "cached"))}})

    return chunks.select(F.col("doc").cast("string"), "id", "content", "text").mapInPandas(run, "doc string, id string, context string, read long, written long, cached long")


def token_usage(calls: DataFrame) -> DataFrame:
    """Sums of read, written and cached tokens, and saved: the percentage of all tokens read that came from the cache, null without any."""
    sums = calls.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "written", "cached")], F.count("*").alias("calls"))
    return sums.withColumn("saved", F.round(F.try_divide(F.col("cached") * F.lit(100.0), F.col("read") + F.col("cached")), 2))


def contextualized(docs: DataFrame, context: Column | None = None) -> DataFrame:
    """path and text with a context comment at the head of each span; the dry run's, or one context for all spans of a row."""
    own = F.lit("[DRY RUN] Context for $1") if context is None else context
    return docs.select("path", injected_context(F.col("text"), own).alias("text"))


def header_sections(docs: DataFrame) -> DataFrame:
    """path, pos, text, words and band of each section: a body is split before every header of the second and third level and at rules of dashes; bands of words are tiny (under 100), small (300), fit (800), large (1500) and huge."""
    body = F.regexp_replace("text", r"(?m)^---[ \t]*$", "\u0001")
    parts = F.filter(F.split(F.regexp_replace(body, r"(?m)^(?=#{2,3} )", "\u0001"), "\u0001"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    rows = docs.select("path", F.posexplode(parts).alias("pos", "text")).withColumn("words", word_count(F.col("text")))
    band = F.when(F.col("words") < 100, "tiny").when(F.col("words") < 300, "small").when(F.col("words") < 800, "fit").when(F.col("words") <= 1500, "large").otherwise("huge")
    return rows.withColumn("band", band)


def state_lines(states: DataFrame) -> DataFrame:
    """session_id and line: a state as text."""
    done = F.transform("completed_skills", lambda x: F.concat(x["skill"], F.lit(" ("), x["result"], F.lit(")")))
    return states.select("session_id", F.concat_ws("\n", F.concat(F.lit("Session: "), F.col("session_id")), F.concat(F.lit("Goal: "), F.coalesce("goal", F.lit("(none)"))), F.concat(F.lit("Active: "), F.array_join("active_states", ", ")), F.concat(F.lit("Completed: "), F.array_join(done, ", "))).alias("line"))


def name_dimension(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """source and target ids of rows that name both ends; a row with an end that has no id is left out. ids: name, id."""
    side = lambda x: ids.select(F.col("name").alias(f"_{x}"), F.col("id").alias(f"{x}_id"))
    return rows.join(side("source"), F.col("source") == F.col("_source")).join(side("target"), F.col("target") == F.col("_target")).drop("_source", "_target")


def write_slug_outputs(chunks: DataFrame, profiles: DataFrame, edges: DataFrame, queries: DataFrame, path: str) -> None:
    """The four outputs of a benchmark corpus."""
    for name, rows in (("chunks", chunks), ("entity-profiles", profiles), ("entity-graph", edges)):
        rows.write.mode("overwrite").json(f"{path}/{name}")
    # a JSON object is a YAML one
    queries.select(F.concat(F.lit("- "), F.to_json(F.struct("id", F.col("text").alias("query")))).alias("value")).write.mode("overwrite").text(f"{path}/queries")
