"""Structural validation: rules over heads parsed as variants and over the tags of bodies, as issue rows. No rule raises.

An issue is doc, line (of the definition in the head, about, or of the body), rule, severity and subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COSTS, ENTITY_TYPES, MEDIA_TYPES, PRIORITIES

ISSUE = ("doc", "line", "rule", "severity", "subject")
LIST_FIELDS = ("preconditions", "postconditions", "related_skills", "state_refs")
STATE_FIELDS = ("state_refs", "preconditions", "postconditions")


def field(value: Column, name: str) -> Column:
    """The field of an object, null where there is none; a JSON null is a value."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_list(value: Column) -> Column:
    return kind(value).startswith("ARRAY")


def is_text(value: Column) -> Column:
    return kind(value) == "STRING"


def items(value: Column) -> Column:
    """The items of a list, each a variant; none of anything else."""
    return F.when(is_list(value), value.cast("array<variant>"))


def _found(rows: DataFrame, when: Column, rule: str, severity: str, subject: Column) -> DataFrame:
    return rows.filter(F.coalesce(when, F.lit(False))).select("doc", F.col("line").cast("long").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def _fields(rows: DataFrame, catalog: DataFrame) -> list[DataFrame]:
    """Issues of the fields that entities and chunks (doc, line, id, v) share. catalog: doc, ref and type of the entities that have both."""
    out = []
    for name in LIST_FIELDS:
        value = field(F.col("v"), name)
        out.append(_found(rows, value.isNotNull() & ~is_list(value), f"{name}_not_list", "error", F.col("id")))
        each = rows.select("doc", "line", "id", F.explode(items(value)).alias("x"))
        out.append(_found(each, ~is_text(F.col("x")), f"{name}_not_text", "error", F.col("id")))
        if name in STATE_FIELDS:
            ref = F.when(text(F.col("x")).startswith("NOT "), F.trim(F.substring(text(F.col("x")), 5, 1 << 20))).otherwise(text(F.col("x")))
            known = each.filter(is_text(F.col("x"))).select("doc", "line", ref.alias("ref")).join(catalog, ["doc", "ref"], "left")
            out.append(_found(known, F.col("type").isNull(), f"{name}_unknown", "error", F.col("ref")))
            out.append(_found(known, F.col("type") != "state", f"{name}_no_state", "error", F.col("ref")))
    cost, again = field(F.col("v"), "cost"), field(F.col("v"), "idempotent")
    out.append(_found(rows, cost.isNotNull() & ~F.coalesce(is_text(cost) & text(cost).isin(*COSTS), F.lit(False)), "bad_cost", "error", F.col("id")))
    out.append(_found(rows, again.isNotNull() & (kind(again) != "BOOLEAN"), "bad_idempotent", "error", F.col("id")))
    return out


def _repeats(rows: DataFrame, rule: str) -> DataFrame:
    again = F.row_number().over(Window.partitionBy("doc", "id").orderBy("line"))
    return _found(rows.withColumn("_n", again), F.col("_n") > 1, rule, "error", F.col("id"))


def head_issues(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Issues of heads. docs: doc, head (JSON, null without one); files: doc and content_path of the media that exist. A long head may come in pieces, rows of one doc that each hold some of its entities and chunks; before is then the number of those of either kind in the pieces before."""
    before = F.col("before") if "before" in docs.columns else F.lit(0)
    heads = docs.select("doc", F.lit(1).alias("line"), before.alias("before"), F.try_parse_json("head").alias("v"))
    chunks, entities = field(F.col("v"), "chunks"), field(F.col("v"), "entities")
    nothing = F.lit(None)
    out = [
        _found(heads, F.col("v").isNull(), "no_head", "warning", nothing),
        _found(heads, F.col("v").isNotNull() & chunks.isNull(), "no_chunks", "warning", nothing),
        _found(heads, entities.isNotNull() & ~is_list(entities), "entities_not_list", "error", nothing),
    ]
    if "before" in docs.columns:
        out = [x.distinct() for x in out]
    placed = lambda x: heads.select("doc", "before", F.posexplode(items(x)).alias("at", "v")).select("doc", (F.col("before") + F.col("at")).alias("pos"), "v").withColumn("line", F.col("pos") + 2)
    each = placed(entities)
    names = [field(F.col("v"), c) for c in ("id", "name", "type")]
    a_thing = kind(F.col("v")).startswith("OBJECT")
    whole = reduce(lambda a, b: a & b, [n.isNotNull() for n in names])
    out += [_found(each, ~a_thing, "entity_no_object", "error", F.col("pos") + 1), _found(each, a_thing & ~whole, "entity_lacks_field", "error", F.col("pos") + 1)]
    # an entity is known by id and type, even without a name; of equal ids the last counts
    typed = each.filter(a_thing & names[0].isNotNull() & names[2].isNotNull()).select("doc", text(F.col("v"), "$.id").alias("ref"), "pos", text(F.col("v"), "$.type").alias("type"))
    catalog = typed.groupBy("doc", "ref").agg(F.max_by("type", "pos").alias("type"))
    good = each.filter(a_thing & whole).select("doc", "line", text(F.col("v"), "$.id").alias("id"), "v")
    own = text(F.col("v"), "$.type")
    out += [_repeats(good, "duplicate_entity"), _found(good, (own != "") & ~own.isin(*ENTITY_TYPES), "unknown_type", "warning", F.col("id")), *_fields(good, catalog)]
    out += _chunk_issues(placed(chunks), catalog, files)
    return reduce(DataFrame.unionByName, out)


def _chunk_issues(each: DataFrame, catalog: DataFrame, files: DataFrame | None) -> list[DataFrame]:
    has = field(F.col("v"), "id").isNotNull()
    rows = each.filter(has).select("doc", "line", "pos", text(F.col("v"), "$.id").alias("id"), "v")
    v = lambda name: field(F.col("v"), name)
    out = [_found(each, ~has, "chunk_lacks_id", "error", F.col("pos") + 1), _repeats(rows, "duplicate_chunk"), _found(rows, v("context").isNull(), "no_context", "warning", F.col("id"))]
    out.append(_found(rows, v("entities").isNotNull() & ~is_list(v("entities")), "entities_no_list", "error", F.col("id")))
    refs = rows.select("doc", "line", "id", F.explode(items(v("entities"))).alias("x"))
    out.append(_found(refs, ~is_text(F.col("x")), "entity_no_text", "error", F.col("id")))
    unknown = refs.filter(is_text(F.col("x"))).select("doc", "line", text(F.col("x")).alias("ref")).join(catalog, ["doc", "ref"], "left_anti")
    out.append(_found(unknown, F.lit(True), "entity_undefined", "error", F.col("ref")))
    made, version = v("created_at"), v("version")
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    dated = is_text(made) & text(made).rlike(iso) & F.try_to_date(F.substring(text(made), 1, 10)).isNotNull()
    # an integer or true, which counts as 1
    number = F.when(kind(version) == "BIGINT", F.try_variant_get(version, "$", "long")).when(kind(version) == "BOOLEAN", F.try_variant_get(version, "$", "boolean").cast("long"))
    out += [_found(rows, made.isNotNull() & ~F.coalesce(dated, F.lit(False)), "bad_created_at", "error", F.col("id")), _found(rows, version.isNotNull() & ~F.coalesce(number >= 1, F.lit(False)), "bad_version", "error", F.col("id"))]
    rank, needs, media, path = v("priority"), v("dependencies"), v("type"), v("content_path")
    one_of = lambda x, allowed: F.coalesce(is_text(x) & text(x).isin(*allowed), F.lit(False))
    out += [_found(rows, rank.isNotNull() & ~one_of(rank, PRIORITIES), "bad_priority", "error", F.col("id")), _found(rows, needs.isNotNull() & ~is_list(needs), "dependencies_not_list", "error", F.col("id"))]
    each_need = rows.select("doc", "line", "id", "pos", F.explode(items(needs)).alias("x"))
    out.append(_found(each_need, ~is_text(F.col("x")), "dependency_not_text", "error", F.col("id")))
    first = rows.groupBy("doc", F.col("id").alias("ref")).agg(F.min("pos").alias("first"))
    met = each_need.filter(is_text(F.col("x"))).select("doc", "line", "pos", text(F.col("x")).alias("ref")).join(first, ["doc", "ref"], "left")
    out.append(_found(met, F.col("first").isNull() | (F.col("first") > F.col("pos")), "dependency_not_found", "warning", F.col("ref")))
    out.append(_found(rows, media.isNotNull() & ~one_of(media, MEDIA_TYPES), "bad_media_type", "error", F.col("id")))
    shown = one_of(media, MEDIA_TYPES[1:])
    out.append(_found(rows, path.isNotNull() & ~shown, "path_of_text", "warning", F.col("id")))
    if files is not None:
        lost = rows.filter(path.isNotNull() & shown).select("doc", "line", "id", text(path).alias("content_path")).join(files, ["doc", "content_path"], "left_anti")
        out.append(_found(lost, F.lit(True), "path_missing", "warning", F.col("id")))
    return out + _fields(rows, catalog)


def body_issues(docs: DataFrame) -> DataFrame:
    """Issues of bodies (doc, head, body, and first_line, the line at which the body begins): tags that heads lack, ids that are tagged twice, defined chunks that no tag uses, tags within tags (subject: the enclosing one and the inner one), closes without an open and opens without a close. On one line all opens come before all closes."""
    parsed = docs.select("doc", "first_line", "body", F.try_parse_json("head").alias("v"))
    defined = parsed.select("doc", F.posexplode(items(field(F.col("v"), "chunks"))).alias("pos", "c")).select("doc", "pos", text(F.col("c"), "$.id").alias("id")).filter("id IS NOT NULL")
    ids = defined.groupBy("doc", "id").agg(F.min("pos").alias("pos"))
    rows = parsed.select("doc", F.posexplode(F.split("body", "\n")).alias("at", "text"), "first_line").withColumn("line", F.col("at") + F.col("first_line"))
    opens = rows.select("doc", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)<Chunk\s+id=[\"']([^\"']+)[\"']>"), 1)).alias("k", "id"))
    closes = rows.select("doc", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)</Chunk>"), 0)).alias("k", "tag"))
    with_head = ids.select("doc").distinct()
    first = F.first_value("line").over(Window.partitionBy("doc", "id").orderBy("line", "k"))
    again = opens.withColumn("first", first).withColumn("_n", F.row_number().over(Window.partitionBy("doc", "id").orderBy("line", "k")))
    out = [
        _found(opens.join(with_head, "doc", "left_semi").join(ids, ["doc", "id"], "left_anti"), F.lit(True), "undefined_tag", "error", F.col("id")),
        _found(again, F.col("_n") > 1, "duplicate_tag", "error", F.concat(F.col("id"), F.lit(" first "), F.col("first").cast("string"))),
        _found(ids.join(opens, ["doc", "id"], "left_anti").withColumn("line", F.col("pos") + 2), F.lit(True), "unused_chunk", "warning", F.col("id")),
    ]
    events = opens.select("doc", "line", F.lit(0).alias("side"), "k", "id", F.lit(1).alias("step")).unionByName(closes.select("doc", "line", F.lit(1).alias("side"), "k", F.lit(None).cast("string").alias("id"), F.lit(-1).alias("step")))
    order = Window.partitionBy("doc").orderBy("line", "side", "k")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = events.withColumn("n", F.row_number().over(order)).withColumn("sum", F.sum("step").over(run))
    depth = depth.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(run))).withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0)))
    later = F.min("after").over(order.rowsBetween(1, Window.unboundedFollowing))
    # the enclosing tag is the last open before that reached the depth at which this one stands
    reached = depth.filter("step = 1").select(F.col("doc").alias("_doc"), F.col("after").alias("_after"), F.col("n").alias("_n"), F.col("id").alias("_id"))
    inner = depth.filter("step = 1 AND before > 0")
    outer = inner.join(reached, (F.col("doc") == F.col("_doc")) & (F.col("before") == F.col("_after")) & (F.col("_n") < F.col("n"))).groupBy("doc", "n", "line", "id").agg(F.max_by("_id", "_n").alias("outer"))
    out += [
        _found(outer, F.lit(True), "nested_tag", "error", F.concat(F.col("outer"), F.lit(" > "), F.col("id"))),
        _found(depth, (F.col("step") == -1) & (F.col("before") == 0), "orphan_close", "error", F.lit(None)),
        _found(depth.withColumn("later", later), (F.col("step") == 1) & F.coalesce(F.col("later") >= F.col("after"), F.lit(True)), "unclosed_tag", "error", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, out)


def severities(issues: DataFrame) -> DataFrame:
    """doc, errors, warnings and infos."""
    return issues.groupBy("doc").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])
