"""Words of whole columns against the patterns, and TF-IDF over texts that are counted where they are read."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from weftgraph.constants import KEYWORD_STOPWORDS, STOPWORDS
from weftgraph.functions import words as W
from weftgraph.operators import vectors

TOKEN = re.compile(r"\b[a-z][a-z0-9_-]+\b", re.ASCII)


def marked(text):
    return "".join("X" if ord(c) > 127 and unicodedata.category(c)[0] in "LN" else c for c in text.lower())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_against_patterns():
    rng = random.Random(2)
    texts = [None, "", "The Go-lang naïve é1x data_set b 42x and K8s your-own", "ab-cdé x-- y--b"]
    texts += ["".join(rng.choice("aabt-c_9 XéŹ.①\n") for _ in range(rng.randrange(14))) for _ in range(4000)]
    plain = [marked(t or "") for t in texts]
    assert [[w.decode() for w in x] for x in W.words(texts, "tokens")] == [[w for w in TOKEN.findall(t) if w not in STOPWORDS] for t in plain]
    assert [[w.decode() for w in x] for x in W.words(texts, "long")] == [[w for w in TOKEN.findall(t) if len(w) > 2 and w not in KEYWORD_STOPWORDS] for t in plain]
    assert [[w.decode() for w in x] for x in W.words(texts, "plain")] == [re.findall(r"\b[a-z]{3,}\b", t, re.ASCII) for t in plain]


def test_texts_are_counted_where_they_are_read(spark):
    docs = spark.createDataFrame([(k, f"red green w{k} w{k % 7}") for k in range(50)], "id long, text string")
    assert "Exchange" not in plan(vectors.term_counts(docs))
    again = docs.unionByName(docs.filter("id < 2"))
    got = {(r["id"], r["token"]): (r["n"], r["size"]) for r in vectors.term_counts(again).collect()}
    assert got[1, "red"] == (2, 4) and got[2, "red"] == (1, 4) and len(got) == 50 * 4 - 7


def test_ranking_and_norms_equal_those_by_joins(spark, monkeypatch):
    monkeypatch.setattr(vectors, "COMMON", 6)
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(9)))) for k in range(120)], "id long, text string")
    queries = spark.createDataFrame([(1, "w0 w1 w50"), (2, "w3 unseen"), (3, "the of"), (4, None), (5, "nowhere")], "id long, text string")
    slow = vectors._joined_scores(queries, docs)
    told = lambda df: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert told(vectors.query_scores(queries, docs)) == told(slow)
    want = vectors.ranked(vectors.with_zeros(slow, queries, docs, 3), "query_id", "id", 3).select("query_id", "id", "rank", F.round("score", 9).alias("score"))
    got = vectors.query_topk(queries, docs, 3).select("query_id", "id", "rank", F.round("score", 9).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    norm = lambda df: sorted((r["id"], round(r["norm"], 9)) for r in df.collect())
    assert norm(vectors.text_norms(docs)) == norm(vectors.norms(vectors.vectors(docs)))


def test_words_are_counted_by_equal_ids(spark):
    rows = [(["a", "b", "a"], 3, "red blue red"), (["a", "b", "a"], 1, "blue the red"), (["b"], 0, "red"), ([], 2, "red"), (["c"], 5, None)]
    df = spark.createDataFrame(rows, "ids array<string>, pos long, text string").coalesce(1)
    got = {(tuple(r["ids"]), r["token"]): (r["n"], tuple(r["first"])) for r in W.counts_by_ids(df, "tokens").collect()}
    assert got == {(("a", "b", "a"), "red"): (3, (1, 1)), (("a", "b", "a"), "blue"): (2, (1, 0)), (("b",), "red"): (1, (0, 0))}


def test_texts_of_lessons_and_mentions_are_not_shuffled(spark):
    from weftgraph.operators import catalog, profiles
    from weftgraph.tables import stored

    lessons = spark.createDataFrame([("l", "walks on graphs", ["A"], ["B"])], "chunk_id string, text string, skills array<string>, prerequisites array<string>")
    names = catalog.named(lessons)
    shown = plan(catalog.lesson_keywords(lessons, names, catalog.entity_catalog(names, least=1)))
    assert "hashpartitioning(chunk_id" not in shown
    chunks = spark.createDataFrame([(0, "c", "ctx", "word " * 200, ["t"], ["s", "n"])], "pos long, chunk_id string, context string, content string, tags array<string>, entities array<string>")
    entities = stored(spark.createDataFrame([("s", "S", "state", [])], "id string, name string, type string, aliases array<string>"))
    found = profiles.mentioned(chunks, entities)
    assert "BroadcastHashJoin" in plan(found)
    assert [(r["id"], len(r["content"].split())) for r in found.collect()] == [("s", 80)]
