"""Validation and diagnosis rules: each returns rows of findings, and none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTEXT_WORDS, GENERIC_NAMES, JACCARD_NEAR, MAX_LINKS, OPENER_OVERLAP, OPENER_WORDS, UBIQUITOUS_SHARE
from ..functions.text import category, is_chunk_id, jaccard, plain_words, split_words, word_count
from . import near


def repeats(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Second and later rows of a key, with first, the position of its first row."""
    window = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(window)).withColumn("first", F.min(position).over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def forward_references(dependencies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Dependencies (doc, pos, target) on no chunk (doc, pos, chunk_id) at or before their own place."""
    seen = chunks.groupBy("doc", "chunk_id").agg(F.min("pos").alias("first")).withColumnsRenamed({"doc": "_doc"})
    on = (F.col("doc") == F.col("_doc")) & (F.col("target") == F.col("chunk_id")) & (F.col("first") <= F.col("pos"))
    return dependencies.join(seen, on, "left_anti")


def outside(value: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a given value is none of those allowed."""
    return value.isNotNull() & ~value.isin(*allowed)


def bad_date(value: Column) -> Column:
    return value.isNotNull() & F.try_to_timestamp(value).isNull()


def bad_version(value: Column) -> Column:
    number = value.try_cast("int")
    return value.isNotNull() & (number.isNull() | (number < 1))


def tag_depths(events: DataFrame) -> DataFrame:
    """events (doc, pos, step: 1 for an open tag, -1 for a close) with depth_before and depth_after, where a close at depth 0 changes nothing."""
    run = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.withColumn("_sum", F.sum("step").over(run))
    depth = summed.withColumn("depth_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(run)))
    return depth.withColumn("depth_before", F.coalesce(F.lag("depth_after").over(Window.partitionBy("doc").orderBy("pos")), F.lit(0))).drop("_sum")


def tag_issues(depths: DataFrame) -> DataFrame:
    """Findings over tag_depths: nested opens, orphan closes, opens that are never closed."""
    later = F.min("depth_after").over(Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    marked = depths.withColumn("_later", later)
    kinds = F.array_compact(F.array(
        F.when((F.col("step") == 1) & (F.col("depth_before") > 0), "nested"),
        F.when((F.col("step") == -1) & (F.col("depth_before") == 0), "orphan"),
        F.when((F.col("step") == 1) & F.coalesce(F.col("_later") >= F.col("depth_after"), F.lit(True)), "unclosed"),
    ))
    return marked.select("doc", "pos", F.explode(kinds).alias("issue"))


def near_pairs(chunks: DataFrame, least: float = JACCARD_NEAR) -> DataFrame:
    """doc, a < b and similarity of chunks (doc, pos, text) of a document whose word sets are this near."""
    return near.near_pairs(chunks, least)


def context_issues(chunks: DataFrame) -> DataFrame:
    """chunk_id, rule and severity of contexts that are empty, short, long, or repeat how the content opens. chunks: chunk_id, context, content."""
    n = word_count(F.coalesce("context", F.lit("")))
    low, high = CONTEXT_WORDS
    opener = plain_words(F.array_join(F.slice(split_words(F.coalesce("content", F.lit(""))), 1, OPENER_WORDS), " "))
    near = jaccard(F.array_distinct(plain_words(F.coalesce("context", F.lit("")))), F.array_distinct(opener)) > OPENER_OVERLAP
    found = F.array_compact(F.array(F.when(n == 0, "empty:error"), F.when((n > 0) & (n < low), "short:warning"), F.when(n > high, "long:info"), F.when((n > 0) & near, "opener:warning")))
    return chunks.select("chunk_id", F.explode(found).alias("f")).select("chunk_id", F.split_part("f", F.lit(":"), F.lit(1)).alias("rule"), F.split_part("f", F.lit(":"), F.lit(2)).alias("severity"))


def ubiquitous_tags(chunks: DataFrame) -> DataFrame:
    """doc, tag and n of tags that nearly all chunks (doc, chunk_id, tags) of a document bear, where there are several such tags and chunks."""
    total = chunks.groupBy("doc").agg(F.countDistinct("chunk_id").alias("total"))
    counted = chunks.select("doc", "chunk_id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("doc", "tag").agg(F.countDistinct("chunk_id").alias("n"))
    common = counted.join(total, "doc").filter((F.col("total") >= 2) & (F.col("n") >= UBIQUITOUS_SHARE * F.col("total")))
    return common.withColumn("_k", F.count("*").over(Window.partitionBy("doc"))).filter("_k > 1").select("doc", "tag", "n")


def same_tags(chunks: DataFrame) -> DataFrame:
    """doc, tags (joined) and n of tag sets that several chunks share."""
    key = F.array_join(F.array_sort(F.array_distinct("tags")), ",")
    return chunks.filter(F.size("tags") > 0).groupBy("doc", key.alias("tag_set")).agg(F.count("*").alias("n")).filter("n > 1")


def singleton_categories(ids: DataFrame) -> DataFrame:
    """Categories of one well-formed id only, where there are several categories and not all are of one."""
    counted = ids.filter(is_chunk_id(F.col("chunk_id"))).groupBy("doc", category(F.col("chunk_id")).alias("category")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("doc")
    return counted.withColumn("_all", F.count("*").over(whole)).withColumn("_one", F.count_if(F.col("n") == 1).over(whole)).filter("n = 1 AND _all > 1 AND _one < _all").select("doc", "category")


def entity_issues(entities: DataFrame) -> DataFrame:
    """entity_id, rule and owner: general names, and names that an earlier entity has. entities: entity_id, pos, name."""
    name = F.lower(F.trim("name"))
    noise = entities.filter(F.lower("name").isin(*GENERIC_NAMES)).select("entity_id", F.lit("noise").alias("rule"), F.lit(None).cast("string").alias("owner"))
    first = F.first_value("entity_id").over(Window.partitionBy(name).orderBy("pos"))
    twins = entities.withColumn("owner", first).filter(F.col("owner") != F.col("entity_id")).select("entity_id", F.lit("duplicate").alias("rule"), "owner")
    return noise.unionByName(twins)


def link_issues(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """chunk_id, rule and detail: too many links, and links to undefined entities, joined in order. chunks: chunk_id, entities."""
    many = chunks.filter(F.size("entities") > MAX_LINKS).select("chunk_id", F.lit("many").alias("rule"), F.size("entities").cast("string").alias("detail"))
    refs = chunks.select("chunk_id", F.posexplode("entities").alias("at", "entity_id")).join(catalog.select("entity_id"), "entity_id", "left_anti")
    lost = refs.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "entity_id"))), lambda x: x["entity_id"]), ",").alias("detail"))
    return many.unionByName(lost.select("chunk_id", F.lit("undefined").alias("rule"), "detail"))


def linked_words(pairs: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """pairs (doc, a, b) with shared: the first few of the words that both chunks (doc, pos, text) hold, sorted and joined."""
    words = lambda end: chunks.select("doc", F.col("pos").alias(end), F.array_distinct(plain_words(F.col("text"))).alias(f"_{end}"))
    met = pairs.join(words("a"), ["doc", "a"]).join(words("b"), ["doc", "b"])
    return met.withColumn("shared", F.array_join(F.slice(F.array_sort(F.array_intersect("_a", "_b")), 1, most), ",")).drop("_a", "_b")


def diagnosed(docs: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Issues of all diagnosis rules in their order: doc, stage, rule, severity, subject, fix (a map, or null). docs: doc; chunks: doc, pos, chunk_id, context, content, tags, entities; entities: doc, pos, entity_id, name. A document without chunks has one structure issue and no other."""
    text = F.concat_ws(" ", F.coalesce("context", F.lit("")), F.coalesce("content", F.lit("")))
    plain = chunks.select("doc", "pos", text.alias("text"))
    names = chunks.select("doc", "pos", "chunk_id")
    key = F.struct("doc", "chunk_id")
    near = near_pairs(plain).join(names.select("doc", F.col("pos").alias("a"), F.col("chunk_id").alias("_a")), ["doc", "a"]).join(names.select("doc", F.col("pos").alias("b"), F.col("chunk_id").alias("_b")), ["doc", "b"])
    context = context_issues(chunks.select(key.alias("chunk_id"), "context", "content"))
    # an entity is defined in its own document only
    refs = F.transform("entities", lambda e: F.struct(F.col("doc").alias("doc"), e.alias("col2")))
    own = entities.select(F.struct("doc", F.col("entity_id").alias("col2")).alias("entity_id"))
    links = _link_issues_by_doc(chunks.select(key.alias("chunk_id"), refs.alias("entities")), own)
    owned = _doc_entity_issues(entities)
    none = F.lit(None).cast("map<string,string>")

    def rows(df: DataFrame, stage: int, rule: Column | str, severity: Column | str, subject: Column, fix: Column = none) -> DataFrame:
        value = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select("doc", F.lit(stage).alias("stage"), value(rule).alias("rule"), value(severity).alias("severity"), subject.cast("string").alias("subject"), fix.alias("fix"))

    of_key = lambda df: df.withColumn("doc", F.col("chunk_id.doc")).withColumn("_id", F.col("chunk_id.chunk_id"))
    wrong = chunks.filter(~is_chunk_id(F.col("chunk_id")))
    suggested = F.when(F.col("rule") == "empty", F.create_map(F.lit("context"), F.concat(F.lit("[write 1-3 sentences on "), F.col("_id"), F.lit("]"))))
    parts = [
        rows(docs.select("doc").distinct().join(chunks.select("doc"), "doc", "left_anti"), 0, "structure", "error", F.lit(None)),
        rows(near, 1, "near", "warning", F.concat_ws(" ", "_a", "_b")),
        rows(of_key(context), 2, F.col("rule"), F.col("severity"), F.col("_id"), suggested),
        rows(ubiquitous_tags(chunks), 3, "ubiquitous", "info", F.col("tag")),
        rows(same_tags(chunks), 3, "same", "warning", F.col("tag_set")),
        rows(wrong, 4, "id", "warning", F.col("chunk_id")),
        rows(singleton_categories(chunks.select("doc", "chunk_id")), 4, "singleton", "info", F.col("category")),
        rows(owned, 5, F.col("rule"), "warning", F.col("entity_id")),
        rows(of_key(links), 6, F.col("rule"), F.when(F.col("rule") == "many", "warning").otherwise("error"), F.col("_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _link_issues_by_doc(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    many = chunks.filter(F.size("entities") > MAX_LINKS).select("chunk_id", F.lit("many").alias("rule"))
    each = chunks.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", F.struct(F.col("e")["doc"].alias("doc"), F.col("e")["col2"].alias("col2")).alias("entity_id"))
    lost = each.join(catalog, "entity_id", "left_anti").select("chunk_id", F.lit("undefined").alias("rule")).distinct()
    return many.unionByName(lost)


def _doc_entity_issues(entities: DataFrame) -> DataFrame:
    """entity_issues within each document."""
    name = F.lower(F.trim("name"))
    first = F.first_value("entity_id").over(Window.partitionBy("doc", name).orderBy("pos"))
    noise = entities.filter(F.lower("name").isin(*GENERIC_NAMES)).select("doc", "entity_id", F.lit("noise").alias("rule"))
    twins = entities.withColumn("owner", first).filter(F.col("owner") != F.col("entity_id")).select("doc", "entity_id", F.lit("duplicate").alias("rule"))
    return noise.unionByName(twins)


def document_stats(chunks: DataFrame, entities: DataFrame, issues: DataFrame) -> DataFrame:
    """doc, chunks, entities, mean_words (of contexts), tags, categories, errors, warnings and infos of each document that has chunks or issues. chunks: doc, chunk_id, context, tags; entities: doc, entity_id; issues: doc, severity."""
    own = chunks.groupBy("doc").agg(F.count("*").alias("chunks"), F.avg(word_count(F.coalesce("context", F.lit("")))).alias("mean_words"), F.countDistinct(F.when(F.contains("chunk_id", F.lit(":")), category(F.col("chunk_id")))).alias("categories"))
    tags = chunks.select("doc", F.explode("tags").alias("t")).groupBy("doc").agg(F.countDistinct("t").alias("tags"))
    known = entities.groupBy("doc").agg(F.count("*").alias("entities"))
    counted = issues.groupBy("doc").agg(*[F.count_if(F.col("severity") == x).alias(f"{x}s") for x in ("error", "warning", "info")])
    met = own.join(tags, "doc", "full").join(known, "doc", "left").join(counted, "doc", "full")
    numbers = ("chunks", "entities", "tags", "categories", "errors", "warnings", "infos")
    return met.select("doc", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("mean_words", F.lit(0.0)).alias("mean_words"))


def merged_fixes(issues: DataFrame) -> DataFrame:
    """doc, subject and fix: the fixes of a chunk as one map, the last stage's value of each key. issues: as diagnosed returns them."""
    each = issues.filter("fix IS NOT NULL").select("doc", "subject", "stage", F.explode("fix").alias("k", "v"))
    last = each.groupBy("doc", "subject", "k").agg(F.max_by("v", F.struct("stage", "v")).alias("v"))
    return last.groupBy("doc", "subject").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fix"))
