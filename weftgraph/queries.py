"""Catalogue of the engine's queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import GENERIC_NAMES, KEYWORD_STOPWORDS, STOPWORDS
from .functions import text as T
from .operators import catalog, checks, graph, mentions, planning, profiles, retrieval, validation, vectors
from .streaming.sessions import active_states, state_counts
from .tables import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- text -----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = r"""list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', 'X', 'g'), '\b[a-z][a-z0-9_-]+\b'), lambda t: t NOT IN (%s))""" % _STOP
_LONG = r"""list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', 'X', 'g'), '\b[a-z][a-z0-9_-]+\b'), lambda t: len(t) > 2 AND t NOT IN (%s))""" % ", ".join(f"'{w}'" for w in KEYWORD_STOPWORDS)
_PLAIN = r"""regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', 'X', 'g'), '\b[a-z]{3,}\b')"""
_TF = f"""tok AS (SELECT id, {_TOKENS} AS t FROM src), one AS (SELECT id, len(t) AS size, unnest(t) AS token FROM tok),
tf AS (SELECT id, token, size, count(*) AS n FROM one GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln((1.0 + (SELECT count(*) FROM src)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token),
vec AS (SELECT id, token, n::DOUBLE / size * idf AS weight FROM tf JOIN idf USING (token)),
norm AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY id)"""


def _tf(k: str) -> str:
    """The same tables over src<k>, their names ending in k."""
    out = _TF
    for name in ("tok", "one", "tf", "idf", "vec", "norm"):
        out = re.sub(rf"\b{name} AS \(", f"{name}{k} AS (", out)
        out = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{k}", out)
    return re.sub(r"\bFROM src\b", f"FROM src{k}", out)


_DOCS = "src AS (SELECT doc_id AS id, text FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_DOCS}, {_TF} SELECT id AS doc_id, token, n FROM tf")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return vectors.term_counts(_docs(spark, d)).select(F.col("id").alias("doc_id"), "token", "n")


@query(f"WITH {_DOCS}, {_TF} SELECT token, df, round(idf, 9) AS idf FROM idf")
def document_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return vectors.frequencies(docs).select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_DOCS}, {_TF} SELECT id AS doc_id, round(norm, 7) AS norm FROM norm")
def doc_vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return vectors.text_norms(_docs(spark, d)).select(F.col("id").alias("doc_id"), F.round("norm", 7).alias("norm"))


_QUERY_SQL = f"""WITH {_DOCS}, {_TF},
qtok AS (SELECT item_id, {_TOKENS} AS t FROM benchmark), qone AS (SELECT item_id, len(t) AS size, unnest(t) AS token FROM qtok),
qtf AS (SELECT item_id, token, size, count(*) AS n FROM qone GROUP BY ALL),
qvec AS (SELECT item_id, token, n::DOUBLE / size * coalesce(idf, ln(2)) AS weight FROM qtf LEFT JOIN idf USING (token)),
qnorm AS (SELECT item_id, sqrt(sum(weight * weight)) AS qn FROM qvec GROUP BY item_id),
scores AS (SELECT item_id, id, sum(v.weight * q.weight) / (norm * qn) AS score FROM vec v JOIN qvec q USING (token) JOIN norm USING (id) JOIN qnorm USING (item_id) GROUP BY item_id, id, norm, qn),
every AS (SELECT item_id, id, score FROM scores UNION ALL SELECT item_id, id, 0.0 FROM benchmark, (SELECT id FROM src ORDER BY id LIMIT 3) WHERE (item_id, id) NOT IN (SELECT (item_id, id) FROM scores)),
ranked AS (SELECT item_id, id AS doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS rank FROM every)"""


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = _docs(spark, d)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return vectors.query_topk(items, docs, k).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 4).alias("score"))


@query(f"{_QUERY_SQL} SELECT item_id, doc_id, rank, score FROM ranked WHERE rank <= 3")
def doc_query_topk_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 3)


@query(f"""{_QUERY_SQL}, hit AS (SELECT item_id, count_if(coalesce(l.quality, 0) = 1) AS good FROM ranked LEFT JOIN labels l USING (doc_id) WHERE rank <= 3 GROUP BY item_id)
SELECT count(*) AS n_queries, count_if(good > 0) AS hits, sum(good)::BIGINT AS recovered, (count(*) * 3 - sum(good))::BIGINT AS missed FROM hit""")
def retrieval_metrics_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    good = _nearest(spark, d, 3).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("item_id").agg(F.count_if(F.coalesce("quality", F.lit(0)) == 1).alias("good"))
    return good.agg(F.count("*").alias("n_queries"), F.count_if(F.col("good") > 0).alias("hits"), F.sum("good").alias("recovered"), (F.count("*") * 3 - F.sum("good")).alias("missed"))


#: Documents are chunks that mention their source and their language; the first texts of both are their contexts.
_LINKS_SQL = """refs AS (SELECT doc_id, 'source ' || source AS node FROM documents UNION ALL SELECT doc_id, 'lang ' || lang FROM documents),
src2 AS (SELECT node AS id, node || chr(10) || string_agg(text, ' ' ORDER BY doc_id) AS text FROM (SELECT node, doc_id, text, row_number() OVER (PARTITION BY node ORDER BY doc_id) AS n FROM refs JOIN documents USING (doc_id)) WHERE n <= 3 GROUP BY node),
co AS (SELECT p.node AS a, q.node AS b, count(*) AS n FROM refs p JOIN refs q ON p.doc_id = q.doc_id AND p.node < q.node GROUP BY ALL), ways AS (SELECT a, b, n::DOUBLE / (SELECT max(n) FROM co) AS s FROM co UNION ALL SELECT b, a, n::DOUBLE / (SELECT max(n) FROM co) FROM co), deg AS (SELECT a AS node, count(*) AS degree FROM ways GROUP BY a)"""
_RERANK_SQL = f"""{_QUERY_SQL}, {_LINKS_SQL}, {_tf("2")},
eqvec AS (SELECT item_id, token, n::DOUBLE / size * coalesce(idf, ln(2)) AS weight FROM qtf LEFT JOIN idf2 USING (token)), eqnorm AS (SELECT item_id, sqrt(sum(weight * weight)) AS qn FROM eqvec GROUP BY item_id),
es AS (SELECT item_id, id AS node, sum(v.weight * q.weight) / (norm * qn) AS score FROM vec2 v JOIN eqvec q USING (token) JOIN norm2 USING (id) JOIN eqnorm USING (item_id) GROUP BY item_id, id, norm, qn),
sd AS (SELECT item_id, node, score / log2(2 + coalesce(degree, 0)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, node) AS n FROM es) LEFT JOIN deg USING (node) WHERE n <= 4 AND score > 0.01),
rc AS (SELECT item_id, node, max(score) AS score FROM (FROM sd UNION ALL SELECT item_id, b, score * s * 0.65 / log2(2 + degree) FROM sd JOIN ways ON a = sd.node JOIN deg ON deg.node = b) GROUP BY ALL),
cv AS (SELECT item_id, doc_id AS id, sum(score) / sqrt(2) AS cover, count(*) AS density FROM refs JOIN rc USING (node) GROUP BY ALL),
fin AS (SELECT item_id, id, 0.35 * coalesce(s.score, 0) / (SELECT max(score) FROM scores m WHERE m.item_id = z.item_id) + 0.55 * coalesce(cover, 0) / coalesce((SELECT max(score) FROM rc WHERE rc.item_id = z.item_id), 1) + 0.10 * least(coalesce(density, 0), 3) / 3.0 AS score
FROM (SELECT item_id, id FROM scores UNION SELECT item_id, id FROM cv) z LEFT JOIN scores s USING (item_id, id) LEFT JOIN cv USING (item_id, id)),
best AS (SELECT item_id, id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 4) AS score FROM fin QUALIFY rank <= 3)"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    refs = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("source "), "source"), F.concat(F.lit("lang "), "lang"))).alias("node")).filter("node IS NOT NULL")
    order = Window.partitionBy("node").orderBy("doc_id")
    first = refs.withColumn("n", F.row_number().over(order)).filter("n <= 3").join(docs.select("doc_id", "text"), "doc_id")
    contexts = first.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("contexts"))
    none = F.array().cast("array<string>")
    profiles = contexts.select(F.col("node").alias("id"), F.col("node").alias("name"), F.lit("").alias("type"), none.alias("aliases"), none.alias("tags"), none.alias("keywords"), "contexts", none.alias("related"), F.lit("").alias("representation"))
    pairs = stored(mentions.co_mentions(refs.select(F.col("doc_id").alias("chunk_id"), F.col("node").alias("entity_id"))))
    edges = pairs.crossJoin(pairs.agg(F.max("n").alias("most"))).select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("n") / F.col("most")).alias("score"))
    base = stored(vectors.query_scores(items, _docs(spark, d)).select(F.col("query_id").alias("key"), F.col("id").alias("chunk_id"), "score"))
    scores = stored(vectors.query_scores(items, retrieval.entity_texts(profiles)).select(F.col("query_id").alias("key"), F.col("id").alias("node"), "score"))
    final = retrieval.reranked(base, scores, edges, refs.select(F.col("doc_id").alias("chunk_id"), "node"))
    return vectors.ranked(final, "key", "chunk_id", 3).select(F.col("key").alias("item_id"), F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 4).alias("score"))


@query(f"{_RERANK_SQL} SELECT item_id, doc_id, rank, score FROM best")
def entity_aware_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d)


_WORDS = r"list_filter(string_split_regex(text, '[\s\p{Z}\x{85}\x0b\x1c-\x1f]+'), lambda w: w <> '')"


@query(f"""SELECT doc_id, len({_WORDS})::BIGINT AS words, md5(CASE WHEN len({_WORDS}) <= 80 THEN text ELSE array_to_string(list_slice({_WORDS}, 1, 80), ' ') END) AS cut FROM documents""")
def truncate_and_wordcount(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.md5(T.truncated(F.col("text"))).alias("cut"))


@query(r"SELECT p_partkey, 'entity:' || regexp_replace(regexp_replace(replace(lower(p_name), '.', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(map {'PROMO': 'product', 'STANDARD': 'tool'}[split_part(p_type, ' ', 1)], 'concept') AS kind FROM part")
def slugify_part_names(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("PROMO", "product", "STANDARD", "tool")))
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), F.coalesce(F.try_element_at(kinds, F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("concept")).alias("kind"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def recode_priority(spark: SparkSession, d: str) -> DataFrame:
    codes = F.create_map(*map(F.lit, ("1-URGENT", "critical", "2-HIGH", "high", "5-LOW", "low")))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(codes, "o_orderpriority"), F.lit("medium")).alias("priority"), T.iso_day(F.col("o_orderdate").cast("string")).alias("day"))


@query(r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s+href="([^"]+)">(.*?)</a>', 1) AS ids, regexp_extract_all(html, '(?is)<a\s+href="([^"]+)">(.*?)</a>', 2) AS texts FROM pages),
e AS (SELECT page_id, unnest(ids) AS span_id, unnest(texts) AS content, generate_subscripts(ids, 1) - 1 AS pos FROM s)
SELECT page_id, span_id, trim(content) AS content FROM e QUALIFY row_number() OVER (PARTITION BY page_id, span_id ORDER BY pos DESC) = 1""")
def html_span_extract(spark: SparkSession, d: str) -> DataFrame:
    return mentions.last_wins(_links(spark, d).withColumn("k", F.struct("page_id", "span_id")), "k", "pos").select("page_id", "span_id", F.trim("content").alias("content"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.lit(r'(?is)<a\s+href="([^"]+)">(.*?)</a>')
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("i"), F.regexp_extract_all("html", pattern, 2).alias("c"))
    return table(spark, d, "pages").select("page_id", F.posexplode(pairs).alias("pos", "s")).select("page_id", "pos", F.col("s.i").alias("span_id"), F.col("s.c").alias("content"))


@query(r"""WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s+href="([^"]+)">(.*?)</a>', 1) AS ids FROM pages), e AS (SELECT page_id, unnest(ids) AS span_id, generate_subscripts(ids, 1) - 1 AS pos FROM s)
SELECT page_id, span_id, pos::BIGINT AS pos, min(pos) OVER w::BIGINT AS first FROM e WINDOW w AS (PARTITION BY page_id, span_id) QUALIFY row_number() OVER (PARTITION BY page_id, span_id ORDER BY pos) > 1""".replace("min(pos) OVER w::BIGINT", "(min(pos) OVER w)::BIGINT"))
def duplicate_span_ids(spark: SparkSession, d: str) -> DataFrame:
    return checks.repeats(_links(spark, d), ["page_id", "span_id"], "pos").select("page_id", "span_id", F.col("pos").cast("long").alias("pos"), F.col("first").cast("long").alias("first"))


_TAG_EVENTS = r"""ev AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, '</?(?:div|p|li|ul|nav)\b')) AS tag, generate_subscripts(regexp_extract_all(html, '</?(?:div|p|li|ul|nav)\b'), 1) - 1 AS pos FROM pages),
s AS (SELECT doc, pos, CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS step FROM ev), r AS (SELECT *, sum(step) OVER (PARTITION BY doc ORDER BY pos) AS total FROM s),
dp AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY doc ORDER BY pos)) AS depth FROM r), b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc ORDER BY pos), 0) AS before, min(depth) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM dp)"""


@query(f"""WITH {_TAG_EVENTS}, f AS (SELECT doc, 'nested' AS issue FROM b WHERE step = 1 AND before > 0 UNION ALL SELECT doc, 'orphan' FROM b WHERE step = -1 AND before = 0 UNION ALL SELECT doc, 'unclosed' FROM b WHERE step = 1 AND coalesce(later >= depth, true))
SELECT doc, issue, count(*) AS n FROM f GROUP BY ALL""")
def html_tag_balance(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.posexplode(F.regexp_extract_all("html", F.lit(r"</?(?:div|p|li|ul|nav)\b"), 0)).alias("pos", "tag"))
    events = tags.select("doc", "pos", F.when(F.col("tag").startswith("</"), -1).otherwise(1).alias("step"))
    return checks.tag_issues(checks.tag_depths(events)).groupBy("doc", "issue").agg(F.count("*").alias("n"))


# --- rules ----------------------------------------------------------------------------------------------------------


def _brand_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as chunks that mention the brands of their parts in line order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    named = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return named.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_brand"))), lambda x: x["p_brand"]).alias("entities")).withColumn("chunk_pos", F.col("chunk_id"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """Some brands; others are unknown."""
    return table(spark, d, "part").filter("p_brand < 'Brand#4'").select(F.col("p_brand").alias("entity_id")).distinct()


_CATALOG = "cat AS (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#4')"


@query(f"WITH {_CATALOG} SELECT DISTINCT p_brand AS entity_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT IN (FROM cat)")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    return mentions.dangling(_brand_chunks(spark, d), _catalog(spark, d))


@query("""WITH t AS (SELECT conv_id AS doc, turn AS pos, role AS chunk_id FROM conversations), dep AS (SELECT conv_id AS doc, turn AS pos, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'tool' END AS target FROM conversations)
SELECT doc, pos::BIGINT AS pos, target FROM dep WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc = dep.doc AND t.chunk_id = dep.target AND t.pos <= dep.pos)""")
def forward_dependency_warnings(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("long").alias("pos"), F.col("role").alias("chunk_id"))
    needs = turns.select("doc", "pos", F.when(F.col("chunk_id") == "user", "assistant").when(F.col("chunk_id") == "assistant", "user").otherwise("tool").alias("target"))
    return checks.forward_references(needs, turns)


@query(r"SELECT p_partkey, p_type || ':' || p_name AS id FROM part WHERE NOT regexp_matches(p_type || ':' || p_name, '^[a-z]+:[a-z0-9-]+$')")
def id_format_issues(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select("p_partkey", F.concat_ws(":", "p_type", "p_name").alias("id"))
    return ids.filter(~T.is_chunk_id(F.col("id")))


@query("""SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click', 'purchase')""")
def unknown_enum_issues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(checks.outside(F.col("event_type"), ("view", "click", "purchase"))).select("event_id", "event_type")


@query(r"""WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN 'day ' || event_id ELSE NULL END AS day, json_extract_string(props, '$.k') AS version FROM events)
SELECT event_id, day IS NOT NULL AND try_cast(day AS DATE) IS NULL AS bad_day, version IS NOT NULL AND coalesce(try_cast(version AS INT) < 1, true) AS bad_version FROM v""")
def temporal_field_issues(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("day "), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", checks.bad_date(day).alias("bad_day"), checks.bad_version(F.get_json_object("props", "$.k")).alias("bad_version"))


_SPLIT = r"list_filter(string_split_regex({0}, '[\s\p{{Z}}\x{{85}}\x0b\x1c-\x1f]+'), lambda w: w <> '')"
_CONTEXTS = f"""t AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS context, text FROM documents),
cw AS (SELECT doc_id, source, len({_SPLIT.format("context")}) AS n, list_distinct({_PLAIN.replace("text", "context")}) AS a, list_distinct({_PLAIN.replace("lower(text)", "lower(array_to_string(list_slice(" + _SPLIT.format("text") + ", 1, 15), ' '))")}) AS b FROM t),
ci AS (SELECT doc_id, source, CASE WHEN n = 0 THEN 'empty' WHEN n < 8 THEN 'short' WHEN n > 50 THEN 'long' END AS rule, CASE WHEN n = 0 THEN 'error' WHEN n < 8 THEN 'warning' ELSE 'info' END AS severity FROM cw WHERE n < 8 OR n > 50
UNION ALL SELECT doc_id, source, 'opener', 'warning' FROM cw WHERE n > 0 AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) > 0.7)"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the first line is the context, the whole text the content."""
    return table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").cast("string").alias("chunk_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("context"), F.col("text").alias("content"), F.array("lang").alias("tags"))


@query(f"WITH {_CONTEXTS} SELECT doc_id::VARCHAR AS chunk_id, rule, severity FROM ci")
def context_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return checks.context_issues(_contexts(spark, d))


#: How a part is written as an entity or a chunk of its brand's head: faults by its key k and size z.
_ENTITY_FIELDS = (("k % 17 <> 0", 'concat(\'"id": "e\', z, \'"\')'), ("k % 13 <> 0", '\'"name": "N"\''), ("k % 19 <> 0", 'concat(\'"type": "\', element_at(array(\'state\', \'tool\', \'alien\'), cast(z % 3 AS int) + 1), \'"\')'), ("k % 7 = 0", '\'"preconditions": "x"\''), ("k % 7 = 1", 'concat(\'"preconditions": ["NOT e\', z + 1, \'", 3]\')'), ("k % 5 = 0", '\'"cost": "dear"\''), ("k % 5 = 1", '\'"idempotent": "yes"\''))
_CHUNK_FIELDS = (
    ("k % 11 <> 0", 'concat(\'"id": "c\', z, \'"\')'), ("k % 6 <> 0", '\'"context": "C"\''), ("k % 9 = 0", '\'"entities": "e1"\''), ("k % 9 = 1", 'concat(\'"entities": ["e\', z, \'", "e99", 4]\')'),
    ("true", 'concat(\'"created_at": "\', if(k % 4 = 0, \'soon\', \'2024-01-01\'), \'"\')'), ("true", 'concat(\'"version": \', case k % 8 when 0 then \'0\' when 1 then \'true\' when 2 then \'"2"\' else \'3\' end)'), ("true", 'concat(\'"priority": "\', if(k % 10 = 0, \'urgent\', \'low\'), \'"\')'),
    ("k % 12 = 0", '\'"dependencies": "c"\''), ("k % 12 = 1", '\'"dependencies": [5]\''), ("k % 12 = 2", 'concat(\'"dependencies": ["c\', z, \'", "c\', z + 1, \'"]\')'),
    ("k % 14 = 0", '\'"type": "pdf"\''), ("k % 14 = 1", 'concat(\'"type": "image", "content_path": "p\', k, \'"\')'), ("k % 14 = 2", '\'"content_path": "x"\''), ("k % 15 = 0", 'concat(\'"state_refs": ["e\', z, \'"]\')'),
)


#: Entities and chunks of a piece of a head.
HEAD_PIECE = 1000


def _heads(spark: SparkSession, d: str) -> DataFrame:
    made = lambda fields: "concat('{', concat_ws(', ', " + ", ".join(f"if({when}, {value}, null)" for when, value in fields) + "), '}')"
    parts = table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    rows = parts.selectExpr("doc", "k", f"if(k % 50 = 0, '7', {made(_ENTITY_FIELDS)}) AS e", f"{made(_CHUNK_FIELDS)} AS c")
    # a brand's head comes in pieces, as it grows with the table
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("k", "e", "c")) - 1)
    listed = rows.groupBy("doc", F.floor(F.col("pos") / HEAD_PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("k", "e", "c"))).alias("l"))
    entities, chunks = F.array_join("l.e", ", "), F.array_join("l.c", ", ")
    return listed.select("doc", F.concat(F.lit('{"entities": ['), entities, F.lit('], "chunks": ['), chunks, F.lit("]}")).alias("head"), (F.col("piece") * HEAD_PIECE).cast("int").alias("before"))


def _state_rules(rows: str, of: str) -> str:
    """Issues of references to states: rows (doc, line, ref), of a field."""
    return f"""SELECT doc, line, '{of}_unknown' AS rule, 'error' AS severity, ref AS subject FROM {rows} WHERE NOT EXISTS (FROM cat WHERE cat.doc = {rows}.doc AND cat.ref = {rows}.ref)
UNION ALL SELECT doc, line, '{of}_no_state', 'error', ref FROM {rows} JOIN cat USING (doc, ref) WHERE type <> 'state'"""


@query(f"""WITH src AS (SELECT p_brand AS doc, p_partkey AS k, p_size AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part), r AS (SELECT *, pos + 2 AS line, 'e' || z AS e, 'c' || z AS c FROM src),
cat AS (SELECT doc, e AS ref, arg_max(['state', 'tool', 'alien'][z % 3 + 1], pos) AS type FROM r WHERE k % 50 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 GROUP BY ALL), g AS (FROM r WHERE k % 50 <> 0 AND k % 17 <> 0 AND k % 13 <> 0 AND k % 19 <> 0), h AS (FROM r WHERE k % 11 <> 0),
pre AS (SELECT doc, line, 'e' || (z + 1) AS ref FROM g WHERE k % 7 = 1), sref AS (SELECT doc, line, e AS ref FROM h WHERE k % 15 = 0), cref AS (SELECT doc, line, unnest([e, 'e99']) AS ref FROM h WHERE k % 9 = 1), firsts AS (SELECT doc, c AS ref, min(pos) AS first FROM h GROUP BY ALL),
need AS (SELECT doc, line, pos, unnest([c, 'c' || (z + 1)]) AS ref FROM h WHERE k % 12 = 2)
SELECT doc, line, 'entity_no_object' AS rule, 'error' AS severity, (pos + 1)::VARCHAR AS subject FROM r WHERE k % 50 = 0
UNION ALL SELECT doc, line, 'entity_lacks_field', 'error', (pos + 1)::VARCHAR FROM r WHERE k % 50 <> 0 AND (k % 17 = 0 OR k % 13 = 0 OR k % 19 = 0)
UNION ALL SELECT doc, line, 'duplicate_entity', 'error', e FROM g QUALIFY row_number() OVER (PARTITION BY doc, e ORDER BY pos) > 1 UNION ALL SELECT doc, line, 'unknown_type', 'warning', e FROM g WHERE z % 3 = 2
UNION ALL SELECT doc, line, 'preconditions_not_list', 'error', e FROM g WHERE k % 7 = 0 UNION ALL SELECT doc, line, 'preconditions_not_text', 'error', e FROM g WHERE k % 7 = 1 UNION ALL {_state_rules("pre", "preconditions")}
UNION ALL SELECT doc, line, 'bad_cost', 'error', e FROM g WHERE k % 5 = 0 UNION ALL SELECT doc, line, 'bad_idempotent', 'error', e FROM g WHERE k % 5 = 1
UNION ALL SELECT doc, line, 'chunk_lacks_id', 'error', (pos + 1)::VARCHAR FROM r WHERE k % 11 = 0 UNION ALL SELECT doc, line, 'duplicate_chunk', 'error', c FROM h QUALIFY row_number() OVER (PARTITION BY doc, c ORDER BY pos) > 1
UNION ALL SELECT doc, line, 'no_context', 'warning', c FROM h WHERE k % 6 = 0 UNION ALL SELECT doc, line, 'entities_no_list', 'error', c FROM h WHERE k % 9 = 0 UNION ALL SELECT doc, line, 'entity_no_text', 'error', c FROM h WHERE k % 9 = 1
UNION ALL SELECT doc, line, 'entity_undefined', 'error', ref FROM cref WHERE NOT EXISTS (FROM cat WHERE cat.doc = cref.doc AND cat.ref = cref.ref)
UNION ALL SELECT doc, line, 'bad_created_at', 'error', c FROM h WHERE k % 4 = 0 UNION ALL SELECT doc, line, 'bad_version', 'error', c FROM h WHERE k % 8 IN (0, 2) UNION ALL SELECT doc, line, 'bad_priority', 'error', c FROM h WHERE k % 10 = 0
UNION ALL SELECT doc, line, 'dependencies_not_list', 'error', c FROM h WHERE k % 12 = 0 UNION ALL SELECT doc, line, 'dependency_not_text', 'error', c FROM h WHERE k % 12 = 1
UNION ALL SELECT doc, line, 'dependency_not_found', 'warning', ref FROM need LEFT JOIN firsts USING (doc, ref) WHERE first IS NULL OR first > pos
UNION ALL SELECT doc, line, 'bad_media_type', 'error', c FROM h WHERE k % 14 = 0 UNION ALL SELECT doc, line, 'path_of_text', 'warning', c FROM h WHERE k % 14 = 2 UNION ALL SELECT doc, line, 'path_missing', 'warning', c FROM h WHERE k % 14 = 1 AND k % 28 <> 1 UNION ALL {_state_rules("sref", "state_refs")}""")
def head_structure_issues(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").filter("p_partkey % 28 = 1").select(F.col("p_brand").alias("doc"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("content_path"))
    return validation.head_issues(stored(_heads(spark, d)), files)


@query("""WITH l AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 9 AS line, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END AS step, 'c' || (turn % 3) AS id FROM conversations),
hd AS (SELECT DISTINCT doc, c.pos, c.id FROM l, (VALUES (0, 'c0'), (1, 'c1'), (2, 'c7')) c(pos, id) WHERE doc % 2 = 0), o AS (FROM l WHERE step = 1), x AS (SELECT *, sum(step) OVER w AS s, min(line) OVER () AS z FROM l WHERE step <> 0 WINDOW w AS (PARTITION BY doc ORDER BY line)),
y AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc ORDER BY line)) AS after FROM x), q AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc ORDER BY line), 0) AS before, min(after) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM y)
SELECT doc, line, 'undefined_tag' AS rule, 'error' AS severity, id AS subject FROM o WHERE doc % 2 = 0 AND id NOT IN ('c0', 'c1', 'c7') UNION ALL SELECT doc, line, 'duplicate_tag', 'error', id || ' first ' || min(line) OVER (PARTITION BY doc, id) FROM o QUALIFY row_number() OVER (PARTITION BY doc, id ORDER BY line) > 1
UNION ALL SELECT doc, pos + 2, 'unused_chunk', 'warning', id FROM hd WHERE NOT EXISTS (FROM o WHERE o.doc = hd.doc AND o.id = hd.id)
UNION ALL SELECT q.doc, q.line, 'nested_tag', 'error', arg_max(p.id, p.line) || ' > ' || q.id FROM q JOIN q p ON p.doc = q.doc AND p.step = 1 AND p.after = q.before AND p.line < q.line WHERE q.step = 1 AND q.before > 0 GROUP BY q.doc, q.line, q.id
UNION ALL SELECT doc, line, 'orphan_close', 'error', NULL FROM q WHERE step = -1 AND before = 0 UNION ALL SELECT doc, line, 'unclosed_tag', 'error', id FROM q WHERE step = 1 AND coalesce(later >= after, true)""")
def body_structure_issues(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("role") == "user", F.concat(F.lit('<Chunk id="c'), (F.col("turn") % 3).cast("string"), F.lit('">'))).when(F.col("role") == "assistant", "</Chunk>").otherwise("text")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", line.alias("line"))
    bodies = turns.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(F.col("doc") % 2 == 0, '{"chunks": [{"id": "c0"}, {"id": "c1"}, {"id": "c7"}]}')
    return validation.body_issues(bodies.select("doc", head.alias("head"), "body", F.lit(10).alias("first_line")))


@query(f"""WITH s AS (SELECT source AS doc, doc_id AS pos, list_distinct({_PLAIN}) AS w FROM documents), o AS (SELECT * FROM s WHERE len(w) > 0)
SELECT p.doc, p.pos AS a, q.pos AS b, round(len(list_intersect(p.w, q.w))::DOUBLE / len(list_distinct(list_concat(p.w, q.w))), 6) AS similarity FROM o p JOIN o q ON p.doc = q.doc AND p.pos < q.pos
WHERE len(p.w) >= 0.59 * len(q.w) AND len(q.w) >= 0.59 * len(p.w) AND len(list_intersect(p.w, q.w))::DOUBLE / len(list_distinct(list_concat(p.w, q.w))) >= 0.6""")
def near_duplicate_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("pos"), "text")
    return checks.near_pairs(chunks).select("doc", "a", "b", F.round("similarity", 6).alias("similarity"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("chunk_id"), F.array("lang", F.when(F.col("n_chars") > 200, "long").otherwise("brief"), F.lit("text")).alias("tags"))


_TAGGED = "src AS (SELECT source AS doc, doc_id, [lang, CASE WHEN n_chars > 200 THEN 'long' ELSE 'brief' END, 'text'] AS tags FROM documents)"


@query(f"""WITH {_TAGGED}, c AS (SELECT doc, tag, count(DISTINCT doc_id) AS n FROM (SELECT doc, doc_id, unnest(tags) AS tag FROM src) GROUP BY ALL), t AS (SELECT doc, count(*) AS total FROM src GROUP BY doc),
u AS (SELECT doc, tag, n FROM c JOIN t USING (doc) WHERE total >= 2 AND n >= 0.8 * total QUALIFY count(*) OVER (PARTITION BY doc) > 1), g AS (SELECT doc, array_to_string(list_sort(list_distinct(tags)), ',') AS tag, count(*) AS n FROM src GROUP BY ALL HAVING count(*) > 1)
SELECT doc, 'ubiquitous' AS rule, tag, n FROM u UNION ALL SELECT doc, 'same', tag, n FROM g""")
def tag_overlap_issues(spark: SparkSession, d: str) -> DataFrame:
    chunks = _tagged(spark, d)
    common = checks.ubiquitous_tags(chunks).select("doc", F.lit("ubiquitous").alias("rule"), "tag", "n")
    return common.unionByName(checks.same_tags(chunks).select("doc", F.lit("same").alias("rule"), F.col("tag_set").alias("tag"), "n"))


@query("""WITH c AS (SELECT o_custkey AS doc, lower(o_orderstatus) AS category, count(*) AS n FROM orders GROUP BY ALL)
SELECT doc, category FROM c QUALIFY n = 1 AND count(*) OVER (PARTITION BY doc) > 1 AND count_if(n = 1) OVER (PARTITION BY doc) < count(*) OVER (PARTITION BY doc)""")
def singleton_categories(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lower("o_orderstatus"), F.lit(":o"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    return checks.singleton_categories(ids)


@query(f"""WITH e AS (SELECT p_partkey AS entity_id, p_partkey AS pos, p_name AS name FROM part UNION ALL SELECT 0, 0, 'Tool'), f AS (SELECT entity_id, first_value(entity_id) OVER (PARTITION BY lower(trim(name)) ORDER BY pos) AS owner FROM e)
SELECT entity_id::VARCHAR AS entity_id, 'noise' AS rule, NULL::VARCHAR AS owner FROM e WHERE lower(name) IN ({", ".join(f"'{n}'" for n in GENERIC_NAMES)}) UNION ALL SELECT entity_id::VARCHAR, 'duplicate', owner::VARCHAR FROM f WHERE owner <> entity_id""")
def entity_noise_and_duplicates(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return checks.entity_issues(parts.unionByName(spark.createDataFrame([("0", 0, "Tool")], "entity_id string, pos long, name string")))


@query(f"""WITH {_CATALOG}, r AS (SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey AS chunk_id, 'many' AS rule, count(*)::VARCHAR AS detail FROM r GROUP BY l_orderkey HAVING count(*) > 6
UNION ALL SELECT l_orderkey, 'undefined', string_agg(p_brand, ',' ORDER BY l_linenumber, p_brand) FROM r WHERE p_brand NOT IN (FROM cat) GROUP BY l_orderkey""")
def entity_link_issues(spark: SparkSession, d: str) -> DataFrame:
    return checks.link_issues(_brand_chunks(spark, d), _catalog(spark, d))


@query(f"""WITH {_CONTEXTS}, iss AS (SELECT source AS doc, severity FROM ci UNION ALL SELECT source, 'warning' FROM documents), st AS (SELECT source AS doc, count(*) AS chunks, 0::BIGINT AS categories, count(DISTINCT lang) AS tags FROM documents GROUP BY source), mw AS (SELECT source AS doc, avg(n) AS mean_words FROM cw GROUP BY source)
SELECT doc, chunks, 0::BIGINT AS entities, tags, categories, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings, count_if(severity = 'info') AS infos, round(any_value(mean_words), 6) AS mean_words FROM st JOIN iss USING (doc) JOIN mw USING (doc) GROUP BY doc, chunks, tags, categories""")
def doc_stats_by_severity(spark: SparkSession, d: str) -> DataFrame:
    chunks = _contexts(spark, d)
    found = checks.context_issues(chunks.select(F.struct("doc", "chunk_id").alias("chunk_id"), "context", "content")).select(F.col("chunk_id.doc").alias("doc"), "severity")
    # an id that is a bare number has no category
    wrong = chunks.filter(~T.is_chunk_id(F.col("chunk_id"))).select("doc", F.lit("warning").alias("severity"))
    none = spark.createDataFrame([], "doc string, entity_id string")
    return checks.document_stats(chunks, none, found.unionByName(wrong)).withColumn("mean_words", F.round("mean_words", 6))


# --- mentions and profiles ------------------------------------------------------------------------------------------


@query(f"WITH {_CATALOG} SELECT p_brand AS entity_id, count(*) AS mention_count, count(DISTINCT l_orderkey) AS chunks FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (FROM cat) GROUP BY 1")
def mention_reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return mentions.mentions(_brand_chunks(spark, d), _catalog(spark, d)).groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.countDistinct("chunk_id").alias("chunks"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_returnflag").join(table(spark, d, "part"), "p_partkey").withColumnRenamed("p_brand", "entity_id")


_CO = "m AS (SELECT DISTINCT l_orderkey AS o, p_brand AS e FROM lineitem JOIN part ON l_partkey = p_partkey), co AS (SELECT p.e AS a, q.e AS b, count(*) AS n FROM m p JOIN m q ON p.o = q.o AND p.e < q.e GROUP BY ALL)"


@query(f"WITH {_CO} SELECT a, b, n FROM co")
def co_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mentions.co_mentions(_found(spark, d))


@query("""WITH m AS (SELECT p_brand AS entity_id, l_orderkey * 10 + l_linenumber AS position, p_name AS context FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY position, context) AS n FROM m)
SELECT entity_id, string_agg(context, '|' ORDER BY n) FILTER (n <= 3) AS contexts, count(*) AS mention_count FROM r GROUP BY entity_id""")
def entity_profile_rollup(spark: SparkSession, d: str) -> DataFrame:
    return mentions.first_contexts(_found(spark, d).select("entity_id", (F.col("chunk_id") * 10 + F.col("l_linenumber")).alias("position"), F.col("p_name").alias("context")))


@query(f"""WITH x AS (SELECT p_brand AS entity_id, p_partkey AS position, p_name || ' ' || p_type AS text FROM part), t AS (SELECT entity_id, position, {_TOKENS} AS t FROM x), e AS (SELECT entity_id, position, unnest(t) AS token, generate_subscripts(t, 1) AS place FROM t),
c AS (SELECT entity_id, token, count(*) AS n, min(position * 1000 + place) AS first FROM e WHERE token <> 'small' GROUP BY ALL)
SELECT entity_id, token, n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first, token) AS rank FROM c QUALIFY rank <= 8""")
def entity_keywords_topk(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    texts = parts.select(F.col("p_brand").alias("entity_id"), F.col("p_partkey").alias("position"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return mentions.keywords(texts, parts.select(F.col("p_brand").alias("entity_id"), F.lit("small").alias("token")).distinct())


#: Documents are chunks that mention their source and their language; a few are entities that act.
_WORLD_SQL = r"""ents AS (SELECT DISTINCT 'source:' || source AS id, 'Source ' || source AS name, 'domain' AS type, ['from ' || source] AS aliases FROM documents UNION ALL SELECT DISTINCT 'lang:' || lang, 'Language ' || lang, 'state', []::VARCHAR[] FROM documents),
ch AS (SELECT doc_id AS pos, 'doc:' || doc_id AS chunk_id, 'of ' || source AS context, text AS content, [lang, CASE WHEN n_chars > 200 THEN 'long' ELSE 'brief' END] AS tags, ['source:' || source, 'lang:' || lang, 'nowhere', 'source:' || source] AS refs FROM documents),
mn AS (SELECT * EXCLUDE (refs) FROM (SELECT * EXCLUDE (refs), refs, unnest(refs) AS id, generate_subscripts(refs, 1) - 1 AS ref_pos FROM ch) WHERE id IN (SELECT id FROM ents)),
rel AS (SELECT a.id, e.name FROM mn a JOIN mn b ON a.chunk_id = b.chunk_id AND a.id <> b.id JOIN ents e ON e.id = b.id)"""
_CUT = f"CASE WHEN len({_WORDS}) <= 80 THEN text ELSE array_to_string(list_slice({_WORDS}, 1, 80), ' ') END".replace("text", "content")


def _world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    source, lang = F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")
    chunks = docs.select(F.col("doc_id").alias("pos"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit("of "), "source").alias("context"), F.col("text").alias("content"), F.array("lang", F.when(F.col("n_chars") > 200, "long").otherwise("brief")).alias("tags"), F.array(source, lang, F.lit("nowhere"), source).alias("entities"))
    sources = docs.select(source.alias("id"), F.concat(F.lit("Source "), "source").alias("name"), F.lit("domain").alias("type"), F.array(F.concat(F.lit("from "), "source")).alias("aliases")).distinct()
    langs = docs.select(lang.alias("id"), F.concat(F.lit("Language "), "lang").alias("name"), F.lit("state").alias("type"), F.array().cast("array<string>").alias("aliases")).distinct()
    return chunks, stored(sources.unionByName(langs))


_LINES_SQL = f"""ln AS (SELECT id, 'name ' || name AS line FROM ents UNION ALL SELECT id, 'type ' || type FROM ents UNION ALL SELECT id, 'aliases ' || array_to_string(aliases, ' ') FROM ents WHERE len(aliases) > 0
UNION ALL SELECT id, unnest(['tags ' || array_to_string(tags, ' '), 'context ' || context, CASE WHEN content <> '' THEN 'content ' || {_CUT} END]) FROM (FROM mn QUALIFY row_number() OVER (PARTITION BY id, chunk_id ORDER BY ref_pos) = 1)
UNION ALL SELECT id, 'related ' || string_agg(DISTINCT name, ' ' ORDER BY name) FROM rel GROUP BY id)"""


@query(f"WITH {_WORLD_SQL}, {_LINES_SQL} SELECT id, md5(line) AS line, count(*) AS n FROM ln WHERE line IS NOT NULL GROUP BY ALL")
def entity_representation_lines(spark: SparkSession, d: str) -> DataFrame:
    chunks, entities = _world(spark, d)
    found = stored(profiles.mentioned(chunks, entities))
    lines = profiles.representation(entities, found, profiles.related_names(found, entities))
    return lines.groupBy("id", F.md5("line").alias("line")).agg(F.count("*").alias("n"))


_PROFILE_LINES = """pl AS (SELECT id, [0, 0, 0, 0] AS spot, 'name: ' || name AS line FROM ents UNION ALL SELECT id, [0, 1, 0, 0], 'type: ' || type FROM ents UNION ALL SELECT id, [2, 2, 0, 0], 'aliases ' || array_to_string(aliases, ' ') FROM ents WHERE len(aliases) > 0
UNION ALL SELECT id, [1, pos, ref_pos, 0], 'tags ' || array_to_string(tags, ' ') FROM mn UNION ALL SELECT id, [1, pos, ref_pos, 1], 'context ' || context FROM mn UNION ALL SELECT id, [1, pos, ref_pos, 2], 'content ' || %s FROM mn WHERE content <> ''
UNION ALL SELECT id, [2, 3, 0, 0], 'related ' || string_agg(DISTINCT name, ' ' ORDER BY name) FROM rel GROUP BY id UNION ALL SELECT id, [2, 4, 0, 0], 'operational_type: ' || type FROM ents WHERE type = 'state')""" % _CUT
_KEYWORDS_SQL = f"""kt AS (SELECT id, pos, ref_pos, {_TOKENS} AS t FROM (SELECT id, pos, ref_pos, concat_ws(' ', context, content, array_to_string(tags, ' ')) AS text FROM mn)), ke AS (SELECT id, pos, ref_pos, unnest(t) AS token, generate_subscripts(t, 1) AS spot FROM kt),
own AS (SELECT id, unnest(list_concat({_TOKENS}, ['name', 'type', 'context', 'content', 'related', 'tags', 'aliases'])) AS token FROM (SELECT id, concat_ws(' ', name, array_to_string(aliases, ' ')) AS text FROM ents)),
kc AS (SELECT id, token, count(*) AS n, min([pos, ref_pos, spot]) AS first FROM ke WHERE (id, token) NOT IN (FROM own) GROUP BY ALL UNION ALL SELECT id, token, count(*), NULL FROM (SELECT id, unnest({_TOKENS.replace("text", "name")}) AS token FROM rel) GROUP BY ALL),
kw AS (SELECT id, token, sum(n) AS n, row_number() OVER (PARTITION BY id ORDER BY sum(n) DESC, min(first) NULLS LAST, token) AS rank FROM kc GROUP BY id, token QUALIFY rank <= 8)"""


@query(f"""WITH {_WORLD_SQL}, {_PROFILE_LINES}, {_KEYWORDS_SQL},
one AS (SELECT id, count(*) AS mention_count, string_agg(chunk_id, ',' ORDER BY pos, ref_pos) AS chunks, array_to_string(list_slice(list(context ORDER BY pos, ref_pos), 1, 3), '|') AS contexts, string_agg(CASE WHEN content <> '' THEN {_CUT} END, '|' ORDER BY pos, ref_pos) AS excerpts FROM mn GROUP BY id)
SELECT e.id, mention_count, md5(chunks) AS chunks, contexts, md5(coalesce(excerpts, '')) AS excerpts, (SELECT string_agg(DISTINCT t, ',' ORDER BY t) FROM (SELECT unnest(tags) AS t FROM mn WHERE mn.id = e.id)) AS tags, (SELECT string_agg(DISTINCT rel.name, ',' ORDER BY rel.name) FROM rel WHERE rel.id = e.id) AS related,
(SELECT string_agg(token, ',' ORDER BY rank) FROM kw WHERE kw.id = e.id) AS keywords, (SELECT md5(string_agg(line, chr(10) ORDER BY spot)) FROM pl WHERE pl.id = e.id) AS representation FROM ents e JOIN one USING (id)""")
def entity_profiles(spark: SparkSession, d: str) -> DataFrame:
    own = profiles.profiles(*_world(spark, d))
    joined = lambda c, by=",": F.array_join(c, by)
    return own.select("id", "mention_count", F.md5(joined("mentioned_chunks")).alias("chunks"), joined("contexts", "|").alias("contexts"), F.md5(joined("content_excerpts", "|")).alias("excerpts"), joined("tags").alias("tags"), joined("related_entities").alias("related"), joined("keywords").alias("keywords"), F.md5("representation").alias("representation"))


_GRAPH_SQL = f"""{_WORLD_SQL}, {_LINES_SQL}, src AS (SELECT id, string_agg(line, chr(10)) AS text FROM ln WHERE line IS NOT NULL GROUP BY id), {_TF}"""
_SHARED = "(SELECT count(DISTINCT a.chunk_id) FROM mn a JOIN mn b ON a.chunk_id = b.chunk_id WHERE a.id = source AND b.id = target) AS shared_chunk_count"


# --- graph ----------------------------------------------------------------------------------------------------------

_BRAND_TEXT = "src AS (SELECT p_brand AS id, string_agg(p_name || ' ' || p_type, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand)"
_EDGE_SQL = """pr AS (SELECT p.id AS s, q.id AS t, sum(p.weight * q.weight) / (np.norm * nq.norm) AS score FROM vec p JOIN vec q ON p.token = q.token AND p.id < q.id JOIN norm np ON np.id = p.id JOIN norm nq ON nq.id = q.id GROUP BY p.id, q.id, np.norm, nq.norm),
bo AS (SELECT s, t, score FROM pr UNION ALL SELECT t, s, score FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, t) AS rank FROM bo WHERE score >= 0.15),
edges AS (SELECT DISTINCT least(s, t) AS source, greatest(s, t) AS target, round(score, 4) AS score FROM rk WHERE rank <= 3)"""


def _brand_texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    listed = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(" ", *columns).alias("t")))).alias("l"))
    return listed.select("id", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def _similar(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return vectors.similar_edges(vectors.cosine_pairs(vectors.vectors(_brand_texts(spark, d, *columns))))


@query(f"WITH {_BRAND_TEXT}, {_TF}, {_EDGE_SQL} SELECT source, target, score FROM edges")
def entity_similar_edges(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "p_name", "p_type")


@query(f"WITH src AS (SELECT p_brand AS id, string_agg(p_name, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand), {_TF}, {_EDGE_SQL} SELECT source, target, score FROM edges")
def metadata_mode_edges(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, "p_name")


@query(f"WITH {_GRAPH_SQL}, {_EDGE_SQL} SELECT source, target, score, {_SHARED} FROM edges")
def graph_from_export_edges(spark: SparkSession, d: str) -> DataFrame:
    return profiles.graph_from_export(*_world(spark, d))[1].select("source", "target", "score", "shared_chunk_count")


@query(f"""WITH {_WORLD_SQL}, src AS (SELECT id, array_to_string(['name ' || name, 'type ' || type, CASE WHEN len(aliases) > 0 THEN 'aliases ' || array_to_string(aliases, ' ') END], chr(10)) AS text FROM ents), {_TF}, {_EDGE_SQL}
SELECT source, target, score, {_SHARED} FROM edges""")
def graph_from_profiles_metadata(spark: SparkSession, d: str) -> DataFrame:
    return profiles.graph_from_profiles(profiles.profiles(*_world(spark, d)), "metadata")[1].select("source", "target", "score", "shared_chunk_count")


#: A small catalogue of skills: name, preconditions, postconditions, cost, idempotent.
SKILLS = (
    ("browse", [], ["view"], "low", True),
    ("inspect", ["view"], ["click"], "low", True),
    ("register", ["view", "NOT signup"], ["signup"], "medium", False),
    ("order", ["click", "signup"], ["purchase"], "high", False),
    ("report", ["error"], ["click"], "medium", False),
    ("guest-order", ["click", "NOT signup"], ["purchase"], "high", False),
)


def _skills(spark: SparkSession) -> DataFrame:
    rows = [(k, n, p, q, c, i) for k, (n, p, q, c, i) in enumerate(SKILLS)]
    return spark.createDataFrame(rows, "pos long, name string, preconditions array<string>, postconditions array<string>, cost string, idempotent boolean")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_SKILLS = "sk AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{n}', {_list(p)}, {_list(q)}, '{c}', {i})" for k, (n, p, q, c, i) in enumerate(SKILLS)) + ") v(pos, name, pre, post, cost, idem))"
_CAUSAL = """made AS (SELECT name AS p, pos, unnest(post) AS state FROM sk), used AS (SELECT name AS c, unnest(pre) AS state FROM sk), fst AS (SELECT state, min(pos) AS first FROM made GROUP BY state),
met AS (SELECT p, c, arg_min(state, first * 1000) AS via FROM made JOIN used USING (state) JOIN fst USING (state) WHERE p <> c AND NOT starts_with(state, 'NOT ') GROUP BY ALL), causal AS (SELECT p AS source, c AS target, 'LEADS_TO' AS relation, via FROM met UNION ALL SELECT c, p, 'REQUIRES', via FROM met)"""


@query(f"WITH {_SKILLS}, {_CAUSAL} SELECT source, target, relation, via FROM causal")
def causal_edge_inference(spark: SparkSession, d: str) -> DataFrame:
    return graph.causal_edges(_skills(spark).withColumnRenamed("name", "entity_id"))


@query(f"WITH {_SKILLS}, {_CAUSAL}, {_BRAND_TEXT}, {_TF}, {_EDGE_SQL} SELECT source, target, 'SIMILAR' AS relation, score, NULL::VARCHAR AS via, 0::BIGINT AS stage FROM edges UNION ALL SELECT source, target, relation, NULL, via, 1 FROM causal UNION ALL SELECT 'browse', 'report', 'EVIDENCE', 0.5, NULL, 2")
def edge_union_with_extras(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([("browse", "report", "EVIDENCE", 0.5)], "source string, target string, relation string, score double")
    return graph.merged_edges(_similar(spark, d, "p_name", "p_type").withColumn("relation", F.lit("SIMILAR")), causal_edge_inference(spark, d), extra).select("source", "target", "relation", "score", "via", "stage")


@query("""SELECT p_brand AS id, count(DISTINCT l_orderkey) AS chunks, count(l_orderkey) AS mention_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand""")
def graph_nodes_with_mentions(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct()
    counted = _found(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("mention_count"))
    return nodes.join(counted, "id", "left").select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("mention_count", F.lit(0)).alias("mention_count"))


_GEO = """g AS (SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'REQUIRES' AS relation FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'EVIDENCE' FROM supplier
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'BLOCKED_BY' ELSE 'SIMILAR' END FROM customer)"""


def _geo(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = table(spark, d, "nation").select(name("nation:", "n_nationkey").alias("source"), name("region:", "n_regionkey").alias("target"), F.lit("REQUIRES").alias("relation"))
    suppliers = table(spark, d, "supplier").select(name("supplier:", "s_suppkey").alias("source"), name("nation:", "s_nationkey").alias("target"), F.lit("EVIDENCE").alias("relation"))
    customers = table(spark, d, "customer").select(name("customer:", "c_custkey").alias("source"), name("nation:", "c_nationkey").alias("target"), F.when(F.col("c_acctbal") < 0, "BLOCKED_BY").otherwise("SIMILAR").alias("relation"))
    return nations.unionByName(suppliers).unionByName(customers)


def _node(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name,)], "node string")


_HOPS = f"""{_GEO}, w AS (SELECT source, target FROM g UNION SELECT target, source FROM g), h1 AS (SELECT DISTINCT target AS node FROM w WHERE source = 'region:1'), h2 AS (SELECT DISTINCT target AS node FROM w JOIN h1 ON source = node WHERE target <> 'region:1' AND target NOT IN (SELECT node FROM h1)),
h AS (SELECT 'region:1' AS node, 0::BIGINT AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)"""


@query(f"WITH {_HOPS} SELECT node, hop FROM h")
def khop_subgraph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(_geo(spark, d), _node(spark, "region:1"))


@query(f"WITH {_HOPS} SELECT g.* FROM g JOIN h ON source = node WHERE hop < 2 UNION ALL SELECT g.* FROM g JOIN h ON target = node WHERE hop < 2")
def khop_subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _geo(spark, d)
    return graph.hop_edges(edges, graph.hops(edges, _node(spark, "region:1")))


_DIST = f"""RECURSIVE {_GEO}, w AS (SELECT source, target, relation, CASE relation WHEN 'REQUIRES' THEN 1 WHEN 'EVIDENCE' THEN 2 ELSE 3 END AS w FROM g WHERE relation <> 'BLOCKED_BY'), b AS (SELECT * FROM w UNION ALL SELECT target, source, relation, w FROM w),
r AS (SELECT 'region:0' AS node, 0 AS distance UNION SELECT b.target, r.distance + b.w FROM r JOIN b ON b.source = r.node WHERE r.distance + b.w <= 4), dist AS (SELECT node, min(distance)::BIGINT AS distance FROM r GROUP BY node)"""


@query(f"WITH {_DIST} SELECT node, distance FROM dist")
def goal_distances(spark: SparkSession, d: str) -> DataFrame:
    return graph.distances(_geo(spark, d), _node(spark, "region:0"))


@query(f"WITH {_DIST}, a AS (SELECT b.target AS node, relation, p.distance AS d0, b.source FROM b JOIN dist p ON p.node = b.source JOIN dist q ON q.node = b.target WHERE p.distance + b.w = q.distance), v AS (SELECT node, relation AS via FROM a QUALIFY row_number() OVER (PARTITION BY node ORDER BY d0, source, relation) = 1) SELECT node, distance, via FROM dist LEFT JOIN v USING (node)")
def goal_distance_via_relation(spark: SparkSession, d: str) -> DataFrame:
    edges = _geo(spark, d)
    return graph.arriving_relations(edges, graph.distances(edges, _node(spark, "region:0")))


_PROP = f"""{_CO}, e AS (SELECT a, b, n::DOUBLE / (SELECT max(n) FROM co) AS s FROM co), w AS (SELECT a AS x, b AS y, s FROM e UNION ALL SELECT b, a, s FROM e), deg AS (SELECT x, count(*) AS degree FROM w GROUP BY x), c AS (SELECT e, count(*)::DOUBLE AS k FROM m GROUP BY e), seed AS (SELECT e AS node, k / (SELECT max(k) FROM c) AS score FROM c ORDER BY k DESC, e LIMIT 4),
pp AS (SELECT node, score FROM seed UNION ALL SELECT y, score * s * 0.65 / log2(2 + degree) FROM seed JOIN w ON w.x = node JOIN deg ON deg.x = y), prop AS (SELECT node, max(score) AS score FROM pp GROUP BY node)"""


@query(f"WITH {_PROP} SELECT 'all' AS key, node, round(score, 6) AS score FROM prop")
def score_propagation(spark: SparkSession, d: str) -> DataFrame:
    found = stored(_found(spark, d).select("entity_id", "chunk_id").distinct())
    pairs = stored(mentions.co_mentions(found))
    most = pairs.agg(F.max("n").alias("most"))
    edges = pairs.crossJoin(most).select(F.col("a").alias("source"), F.col("b").alias("target"), (F.col("n") / F.col("most")).alias("score"))
    counts = found.groupBy(F.col("entity_id").alias("node")).agg(F.count("*").alias("k"))
    seeds = counts.orderBy(F.desc("k"), "node").limit(4).crossJoin(counts.agg(F.max("k").alias("most"))).select(F.lit("all").alias("key"), "node", (F.col("k") / F.col("most")).alias("score"))
    return graph.propagated(seeds, edges).select("key", "node", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT source, target, max(score) AS score FROM (SELECT least(a.p_brand, b.p_brand) AS source, greatest(a.p_brand, b.p_brand) AS target, CASE WHEN a.p_type = b.p_type THEN 0.85 ELSE 0.65 END AS score FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand) GROUP BY ALL) SELECT source, target, score::DOUBLE AS score FROM e""")
def skill_graph_edges_maxmerge(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count("*").alias("n"))
    a, b = parts.select("p_name", F.col("p_brand").alias("source"), F.col("p_type").alias("ta")), parts.select("p_name", F.col("p_brand").alias("target"), F.col("p_type").alias("tb"))
    return graph.strongest(a.join(b, "p_name").filter("source <> target").select("source", "target", F.when(F.col("ta") == F.col("tb"), 0.85).otherwise(0.65).alias("score")))


@query(f"WITH {_CATALOG}, c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_name, n FROM c WHERE n >= 5 OR p_brand IN (FROM cat)")
def min_mention_catalog(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    known = _catalog(spark, d).select(F.col("entity_id").alias("p_brand"), F.lit(True).alias("known"))
    return counted.join(known, "p_brand", "left").filter("n >= 5 OR known").select("p_brand", "p_name", "n")


#: Orders as lessons: skills are the parts of their lines, prerequisites the types of these, in line order.
_LESSONS = r"""nm AS (SELECT l_orderkey AS chunk_id, p_name || '.' || p_brand AS name, 'skill' AS kind FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT l_orderkey, p_type, 'prerequisite' FROM lineitem JOIN part ON l_partkey = p_partkey),
na AS (SELECT *, 'entity:' || trim(regexp_replace(replace(lower(name), '.', ''), '[^a-z0-9]+', '-', 'g'), '-') AS entity_id FROM nm),
cg AS (SELECT entity_id, min(name) AS name, count(*) AS mentions FROM na GROUP BY entity_id HAVING count(*) >= 5 OR entity_id = 'entity:economy')"""


def _lessons(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("."), "p_brand").alias("skill"), "p_type")
    rows = lines.join(parts, "p_partkey").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "skill", "p_type"))).alias("lines"))
    return rows.select("chunk_id", F.col("lines.skill").alias("skills"), F.col("lines.p_type").alias("prerequisites"))


def _catalogued(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = stored(catalog.named(_lessons(spark, d)))
    return names, stored(catalog.entity_catalog(names, spark.createDataFrame([("entity:economy",)], "entity_id string")))


@query(f"WITH {_LESSONS} SELECT entity_id, name, mentions FROM cg")
def lesson_entity_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _catalogued(spark, d)[1].select("entity_id", "name", "mentions")


@query(f"""WITH {_LESSONS}, st AS (SELECT DISTINCT 'entity:' || trim(regexp_replace(replace(lower(p_name || '.' || p_brand), '.', ''), '[^a-z0-9]+', '-', 'g'), '-') AS a, 'entity:' || lower(p_type) AS b, CASE WHEN p_size > 25 THEN 0.85 ELSE 0.65 END AS score FROM part),
ed AS (SELECT * FROM st UNION ALL SELECT DISTINCT s.entity_id, p.entity_id, 0.70 FROM na s JOIN na p USING (chunk_id) WHERE s.kind = 'skill' AND p.kind = 'prerequisite' AND s.entity_id <> p.entity_id)
SELECT least(a, b) AS source, greatest(a, b) AS target, max(score)::DOUBLE AS score FROM ed WHERE a IN (SELECT entity_id FROM cg) AND b IN (SELECT entity_id FROM cg) GROUP BY ALL""")
def lesson_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    names, known = _catalogued(spark, d)
    parts = table(spark, d, "part")
    stated = parts.select(F.concat("p_name", F.lit("."), "p_brand").alias("source"), F.col("p_type").alias("target"), F.when(F.col("p_size") > 25, "requires").otherwise("relatedTo").alias("relation")).distinct()
    return catalog.catalog_edges(stated, names, known)


@query(f"""WITH {_LESSONS}, co AS (SELECT e.entity_id, s.name AS skill, count(*) AS n FROM na e JOIN na s USING (chunk_id) WHERE s.kind = 'skill' AND s.entity_id <> e.entity_id AND e.entity_id IN (SELECT entity_id FROM cg) GROUP BY ALL)
SELECT entity_id, skill, n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, skill) AS rank FROM co QUALIFY rank <= 8""")
def lesson_co_skills(spark: SparkSession, d: str) -> DataFrame:
    return catalog.co_skills(*_catalogued(spark, d)).select("entity_id", "skill", F.col("n").cast("long").alias("n"), "rank")


@query(f"""WITH tk AS (SELECT doc_id, lang, source, unnest({_LONG}) AS token FROM documents), ct AS (SELECT 'entity:' || e AS entity_id, token, count(*) AS n FROM (SELECT token, lang AS e FROM tk UNION ALL SELECT token, source FROM tk) WHERE e IS NOT NULL GROUP BY ALL)
SELECT entity_id, token, n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, token) AS rank FROM ct QUALIFY rank <= 10""")
def lesson_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lessons of their language, with their source as what they need."""
    lessons = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.array("lang").alias("skills"), F.array("source").alias("prerequisites"))
    names = catalog.named(lessons)
    return catalog.lesson_keywords(lessons, names, catalog.entity_catalog(names, least=1)).select("entity_id", "token", F.col("n").cast("long").alias("n"), "rank")


# --- planning -------------------------------------------------------------------------------------------------------

#: A session is a user; a state is active if the last of its events has a value over 50. What the goal gives is never active at first.
_SESSIONS = """se AS (SELECT user_id AS session_id, coalesce(list_sort(list(event_type) FILTER (value > 50 AND event_type <> 'purchase')), []::VARCHAR[]) AS active
FROM (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL) GROUP BY user_id)"""
_UNMET = "list_filter(pre, lambda p: CASE WHEN starts_with(p, 'NOT ') THEN list_contains(active, substr(p, 5)) ELSE NOT list_contains(active, p) END)"


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("session_id"), "event_type").agg(F.max_by("value", "event_id").alias("value"))
    states = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.when((F.col("value") > 50) & (F.col("event_type") != "purchase"), F.col("event_type")))).alias("active"))
    return states.select("session_id", F.lit("purchase").alias("goal"), "active", F.array().cast("array<string>").alias("completed"))


@query(f"WITH {_SKILLS}, {_SESSIONS} SELECT session_id, name, array_to_string({_UNMET}, ',') AS unmet FROM se, sk")
def precondition_check(spark: SparkSession, d: str) -> DataFrame:
    pairs = _sessions(spark, d).crossJoin(_skills(spark))
    return pairs.select("session_id", "name", F.array_join(planning.unmet(F.col("active"), F.col("preconditions")), ",").alias("unmet"))


#: Relations between states; distances from the goal go over them.
STATE_EDGES = (("view", "click", "LEADS_TO"), ("click", "purchase", "REQUIRES"), ("signup", "purchase", "IMPLIES"), ("error", "click", "BLOCKED_BY"), ("view", "signup", "SIMILAR"))
_NEAR = "near AS (SELECT * FROM (VALUES ('purchase', 0::BIGINT), ('click', 1::BIGINT), ('signup', 2::BIGINT), ('view', 2::BIGINT)) v(node, distance))"
_RANKED = f"""c AS (SELECT session_id, name, CASE cost WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END::BIGINT AS cost_rank, len(post) AS produces, (SELECT coalesce(min(distance), 9223372036854775807) FROM near WHERE list_contains(post, node)) AS proximity FROM se, sk WHERE len({_UNMET}) = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cost_rank, proximity, produces DESC, name) AS rank FROM c)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame(STATE_EDGES, "source string, target string, relation string")
    return planning.candidates(_sessions(spark, d), _skills(spark), graph.distances(edges, _node(spark, "purchase")))


@query(f"WITH {_SKILLS}, {_SESSIONS}, {_NEAR}, {_RANKED} SELECT session_id, name, cost_rank, proximity, rank FROM rk")
def eligible_candidates_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("session_id", "name", "cost_rank", "proximity", "rank")


@query(f"""WITH {_SKILLS}, {_SESSIONS}, {_NEAR}, {_RANKED}, w AS (SELECT * FROM rk WHERE rank = 1)
SELECT session_id, w.name AS winner, r.name, coalesce(nullif(concat_ws('; ', CASE WHEN r.cost_rank > w.cost_rank THEN 'cost ' || ['low', 'medium', 'high'][r.cost_rank + 1] || ' > ' || ['low', 'medium', 'high'][w.cost_rank + 1] END,
CASE WHEN r.proximity > w.proximity THEN 'proximity ' || r.proximity || ' > ' || w.proximity END, CASE WHEN r.produces < w.produces THEN 'fewer postconditions (' || r.produces || ' < ' || w.produces || ')' END), ''), 'same score, lower alphabetical rank') AS reason
FROM rk r JOIN w USING (session_id) WHERE r.rank > 1""")
def selection_explanation(spark: SparkSession, d: str) -> DataFrame:
    return planning.selection_reasons(_ranked(spark, d))


_USABLE = _UNMET.replace("active", "r.active")
_PLAN = f"""RECURSIVE {_SKILLS}, {_SESSIONS}, r AS (SELECT session_id, active, []::VARCHAR[] AS done, []::BIGINT[] AS path FROM se UNION ALL
SELECT session_id, list_sort(list_distinct(list_concat(r.active, post))), list_append(done, name), list_append(path, pos) FROM r, sk WHERE len(path) < 4 AND NOT list_contains(r.active, 'purchase') AND len({_USABLE}) = 0 AND (idem OR NOT list_contains(done, name))),
pl AS (SELECT session_id, path FROM r WHERE list_contains(active, 'purchase') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY len(path), path) = 1)"""


@query(f"WITH {_PLAN} SELECT session_id, array_to_string(list_transform(path, lambda p: [{', '.join(chr(39) + s[0] + chr(39) for s in SKILLS)}][p + 1]), ',') AS path, len(path)::BIGINT AS depth FROM pl")
def lookahead_plan(spark: SparkSession, d: str) -> DataFrame:
    return planning.plans(_sessions(spark, d), _skills(spark), 4).select("session_id", F.array_join("path", ",").alias("path"), "depth")


_PLAN_NAMES = f"[{', '.join(chr(39) + x[0] + chr(39) for x in SKILLS)}]"


@query(f"""WITH {_PLAN}, st AS (SELECT session_id, unnest(path) AS pos, generate_subscripts(path, 1) - 1 AS step, path FROM pl),
ts AS (SELECT session_id, step, name, post, list_distinct(flatten([active] || coalesce((SELECT list(k.post) FROM st b JOIN sk k USING (pos) WHERE b.session_id = st.session_id AND b.step < st.step), []))) AS world FROM st JOIN sk USING (pos) JOIN se USING (session_id))
SELECT session_id, step, name, array_to_string(list_filter(post, lambda p: NOT list_contains(world, p)), ',') AS added, array_to_string(list_filter(post, lambda p: list_contains(world, p)), ',') AS present FROM ts""")
def plan_step_traces(spark: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(spark, d)
    paths = planning.plans(sessions, _skills(spark), 4).join(sessions.select("session_id", "active"), "session_id")
    return planning.step_traces(paths, _skills(spark))


_COSTS = "list_sum(list_transform({0}, lambda p: [%s][p + 1]))" % ", ".join(str({"low": 0, "medium": 1, "high": 2}[x[3]]) for x in SKILLS)


@query(f"""WITH {_PLAN}, goal AS (SELECT session_id, path FROM r WHERE list_contains(active, 'purchase')), st AS (SELECT session_id, path AS best, unnest(path) AS pos, generate_subscripts(path, 1) AS spot FROM pl),
alt AS (SELECT st.session_id, best, spot, path FROM st JOIN goal ON goal.session_id = st.session_id AND NOT list_contains(path, pos) QUALIFY row_number() OVER (PARTITION BY st.session_id, spot ORDER BY len(path), path) = 1),
u AS (SELECT session_id, best, path, min(spot) AS spot FROM alt GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY spot) AS rank, {_COSTS.format("path")}::BIGINT AS its, {_COSTS.format("best")}::BIGINT AS own FROM u)
SELECT session_id, rank, array_to_string(list_transform(path, lambda p: {_PLAN_NAMES}[p + 1]), ',') AS path, CASE WHEN len(path) > len(best) THEN len(path) || ' steps vs ' || len(best) || ' — longer' WHEN its > own THEN 'same length, higher total cost (score ' || its || ' vs ' || own || ')'
WHEN its < own THEN 'same length, lower total cost (score ' || its || ' vs ' || own || ')' ELSE 'same length and cost, lower priority' END AS reason FROM k WHERE rank < 3""")
def alternative_plans(spark: SparkSession, d: str) -> DataFrame:
    sessions, skills = _sessions(spark, d), _skills(spark)
    others = planning.alternatives(sessions, skills, planning.plans(sessions, skills, 4), 4)
    return others.select("session_id", "rank", F.array_join("path", ",").alias("path"), "reason")


_LOOP = f"""RECURSIVE {_SKILLS}, {_SESSIONS}, g AS (SELECT session_id, 0::BIGINT AS iteration, active, active AS before, []::VARCHAR[] AS done, NULL::VARCHAR AS name, []::VARCHAR[] AS told FROM se UNION ALL
SELECT session_id, iteration + 1, list_sort(list_distinct(list_concat(active, post))), active, list_append(done, k), k, post FROM (SELECT g.session_id, g.iteration, g.active, g.done, sk.name AS k, sk.post, row_number() OVER (PARTITION BY session_id ORDER BY CASE cost WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END, len(post) DESC, sk.name) AS rank
FROM g, sk WHERE iteration < 4 AND NOT list_contains(active, 'purchase') AND len({_UNMET}) = 0 AND (idem OR NOT list_contains(done, sk.name))) WHERE rank = 1)"""


@query(f"WITH {_LOOP} SELECT session_id, iteration, name, 'success' AS result, array_to_string(list_filter(told, lambda p: NOT list_contains(before, p)), ',') AS added FROM g WHERE iteration > 0")
def session_loop_history(spark: SparkSession, d: str) -> DataFrame:
    history = planning.run_sessions(_sessions(spark, d), _skills(spark), 4)[0]
    return history.select("session_id", "iteration", "name", "result", F.array_join("added", ",").alias("added"))


@query(f"WITH {_LOOP} SELECT session_id, name AS source, unnest(told) AS target, 'COMPLETED' AS relation, 1.0::DOUBLE AS score, 'active' AS status FROM g WHERE iteration > 0")
def completed_edge_writeback(spark: SparkSession, d: str) -> DataFrame:
    history = planning.run_sessions(_sessions(spark, d), _skills(spark), 4)[0]
    return planning.completed_edges(history).select("session_id", "source", "target", "relation", "score", "status")


@query("""WITH l AS (SELECT user_id AS session_id, event_type AS state, CASE WHEN value > 50 THEN 'add' ELSE 'remove' END AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT session_id, coalesce(string_agg(state, ',' ORDER BY state) FILTER (op = 'add'), '') AS active FROM l GROUP BY session_id""")
def active_state_set_ops(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, "add").otherwise("remove").alias("op"), F.col("event_type").alias("state"))
    return active_states(log)


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 3""")
def embedding_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.dense_cosine_topk(points, points, 3).select("query_id", "id", "rank")


@query("""WITH x(pos, key, term) AS (VALUES (0, 'the', 'article'), (1, 'AND', 'joint'), (2, 'ing', 'gerund')) SELECT item_id, text || coalesce(' ' || string_agg(term, ' ' ORDER BY pos), '') AS expanded FROM benchmark LEFT JOIN x ON contains(lower(text), lower(key)) GROUP BY item_id, text""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    terms = [("the", "article"), ("AND", "joint"), ("ing", "gerund")]
    added = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(key.lower())), F.lit(term)) for key, term in terms]))
    return table(spark, d, "benchmark").select("item_id", F.concat_ws(" ", F.array("text"), added).alias("expanded"))


@query(r"""SELECT doc_id, md5('<Chunk id="doc:' || doc_id || '">' || chr(10) || '<!-- Context: of ' || source || ' -->' || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '</Chunk>') AS injected FROM documents""")
def context_comment_injection(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit('<Chunk id="doc:'), F.col("doc_id").cast("string"), F.lit('"> '), F.col("text"), F.lit(" </Chunk>"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.injected_context(wrapped, F.concat(F.lit("of "), F.col("source")))).alias("injected"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def streaming_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return state_counts(table(spark, d, "events"))
