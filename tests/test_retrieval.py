"""Reranking by entities and diagnosis, on hand-made tables."""

import math

from weftgraph.operators import checks, profiles, retrieval


def test_rerank_by_hand(spark):
    edges = spark.createDataFrame([("a", "b", "SIMILAR", 0.5), ("a", "c", "REQUIRES", None)], "source string, target string, relation string, score double")
    base = spark.createDataFrame([("q", "x", 0.4), ("q", "y", 0.2)], "key string, chunk_id string, score double")
    scores = spark.createDataFrame([("q", "a", 0.8), ("q", "d", 0.005)], "key string, node string, score double")
    refs = spark.createDataFrame([("y", "a"), ("y", "b"), ("y", "b"), ("y", "n"), ("z", "c")], "chunk_id string, node string")
    got = {r["chunk_id"]: r["score"] for r in retrieval.reranked(base, scores, edges, refs).collect()}
    a = 0.8 / math.log2(4)
    b = a * 0.5 * 0.65 / math.log2(3)
    assert abs(got["x"] - 0.35) < 1e-12 and "z" not in got
    assert abs(got["y"] - (0.35 * 0.5 + 0.55 * (a + 2 * b) / 2 / a + 0.10)) < 1e-12
    none = scores.limit(0)
    assert {r["chunk_id"]: round(r["score"], 9) for r in retrieval.reranked(base, none, edges, refs).collect()} == {"x": 0.35, "y": 0.175}


def test_rerank_lifts_what_words_miss(spark):
    """A chunk that shares no word with the query is found by the entity that it mentions."""
    names = spark.createDataFrame([("e", "Engine")], "entity_id string, name string")
    chunks = spark.createDataFrame([("m", "on motors", "they turn", ["t"], ["e", "lost"]), ("n", "", "other text", [], [])], "chunk_id string, context string, content string, tags array<string>, entities array<string>")
    assert {r["id"]: r["text"] for r in retrieval.chunk_texts(chunks, names).collect()} == {"m": "on motors\nthey turn\nt\nEngine", "n": "other text"}
    base = spark.createDataFrame([("q", "n", 0.1)], "key string, chunk_id string, score double")
    scores = spark.createDataFrame([("q", "e", 0.9)], "key string, node string, score double")
    edges = spark.createDataFrame([], "source string, target string, score double")
    refs = spark.createDataFrame([("m", "e")], "chunk_id string, node string")
    got = sorted(((r["score"], r["chunk_id"]) for r in retrieval.reranked(base, scores, edges, refs).collect()), reverse=True)
    assert [c for _, c in got] == ["m", "n"]


def test_diagnosis_of_a_document(spark):
    docs = spark.createDataFrame([("d",), ("none",)], "doc string")
    words = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [("d", 0, "x:1", words, f"{words} more", ["t"], ["e"]), ("d", 1, "x:2", words, f"{words} more", ["t"], ["e", "gone"]), ("d", 2, "y:1", "", "plain words", ["u"], list("abcdefg")), ("d", 3, "Bad", "two words", "body", [], [])]
    chunks = spark.createDataFrame(rows, "doc string, pos long, chunk_id string, context string, content string, tags array<string>, entities array<string>")
    entities = spark.createDataFrame([("d", 0, "e", "Tool"), ("d", 1, "f", " tool "), *[("d", 2 + k, c, c) for k, c in enumerate("abcdg")]], "doc string, pos long, entity_id string, name string")
    found = checks.diagnosed(docs, chunks, entities)
    got = sorted((r["doc"], r["rule"], r["severity"], r["subject"] or "") for r in found.collect())
    assert got == sorted([
        ("none", "structure", "error", ""), ("d", "near", "warning", "x:1 x:2"), ("d", "empty", "error", "y:1"), ("d", "short", "warning", "Bad"), ("d", "opener", "warning", "x:1"), ("d", "opener", "warning", "x:2"),
        ("d", "same", "warning", "t"), ("d", "id", "warning", "Bad"), ("d", "singleton", "info", "y"), ("d", "noise", "warning", "e"), ("d", "duplicate", "warning", "f"),
        ("d", "many", "warning", "y:1"), ("d", "undefined", "error", "x:2"),
    ])
    stats = {r["doc"]: r for r in checks.document_stats(chunks, entities, found).collect()}
    assert (stats["d"]["chunks"], stats["d"]["entities"], stats["d"]["tags"], stats["d"]["categories"], stats["d"]["mean_words"], stats["d"]["errors"], stats["d"]["infos"]) == (4, 7, 2, 2, 4.5, 2, 1) and stats["none"]["errors"] == 1
    assert [(r["subject"], r["fix"]) for r in checks.merged_fixes(found).collect()] == [("y:1", {"context": "[write 1-3 sentences on y:1]"})]
    pairs = spark.createDataFrame([("d", 0, 1)], "doc string, a long, b long")
    assert checks.linked_words(pairs, chunks.selectExpr("doc", "pos", "context AS text"), 3).first()["shared"] == "alpha,beta,delta"


def test_profiles_of_entities_without_mentions(spark):
    entities = spark.createDataFrame([("s", "S", "state", ["sig"]), ("t", "T one", "tool", [])], "id string, name string, type string, aliases array<string>")
    chunks = spark.createDataFrame([(0, "x:1", "ctx", "sig said sig word", ["tag"], ["s", "s"])], "pos long, chunk_id string, context string, content string, tags array<string>, entities array<string>")
    got = {r["id"]: r for r in profiles.profiles(chunks, entities).collect()}
    assert got["s"]["mentioned_chunks"] == ["x:1", "x:1"] and got["s"]["representation"].split("\n") == ["name: S", "type: state", "tags tag", "context ctx", "content sig said sig word"] + ["tags tag", "context ctx", "content sig said sig word", "aliases sig", "operational_type: state"]
    assert got["s"]["keywords"] == ["ctx", "said", "word", "tag"] and got["t"]["mention_count"] == 0 and got["t"]["representation"] == "name: T one\ntype: tool"
    blank = spark.createDataFrame([("s", " \n"), ("t", "own text")], "id string, text string")
    assert {r["id"]: r["text"] for r in profiles.or_metadata(blank, entities).collect()} == {"s": "name S\ntype state\naliases sig", "t": "own text"}
    own, edges, meta = profiles.graph_from_export(chunks, entities, min_score=0.0)
    assert {r["id"]: (r["mention_count"], r["chunk_ids"]) for r in own.collect()} == {"s": (1, ["x:1"]), "t": (0, [])} and meta.first()["entity_count"] == 2
