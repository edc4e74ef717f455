"""Operators on small hand-written rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from weftgraph import queries
from weftgraph.constants import STOPWORDS
from weftgraph.functions import text as T
from weftgraph.operators import checks, graph, mentions, planning, vectors
from weftgraph.sources import markdown
from weftgraph.streaming.sessions import active_states, state_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tokens_bind_non_ascii_letters(spark):
    df = spark.createDataFrame([("The Go-lang naïve é1x data_set b 42x and K8s",)], "t string")
    assert df.select(T.tokens(F.col("t"))).first()[0] == ["go-lang", "data_set", "k8s"]


def test_tfidf_against_brute_force(spark):
    texts = {1: "red green red", 2: "green blue", 3: "", 4: "red apple the"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    split = {i: [w for w in re.findall(r"\b[a-z][a-z0-9_-]+\b", t) if w not in STOPWORDS] for i, t in texts.items()}
    want = {}
    for i, words in split.items():
        for w in set(words):
            df_ = sum(w in v for v in split.values())
            want[i, w] = words.count(w) / len(words) * (math.log((1 + 4) / (1 + df_)) + 1)
    got = {(r["id"], r["token"]): r["weight"] for r in vectors.vectors(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_query_ranking_is_full_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "plum pie"), (3, "stone")], "id long, text string")
    queries = spark.createDataFrame([(7, "apple"), (8, "zebra")], "id long, text string")
    scores = vectors.with_zeros(vectors.query_scores(queries, docs), queries, docs, 3)
    got = [(r["query_id"], r["rank"], r["id"]) for r in vectors.ranked(scores, "query_id", "id", 3).collect()]
    assert sorted(got) == [(7, 1, 1), (7, 2, 2), (7, 3, 3), (8, 1, 1), (8, 2, 2), (8, 3, 3)]


def test_every_twentieth_vector_is_a_query(spark, tmp_path):
    points = {k: [math.cos(k * k), math.sin(k * k), math.cos(3 * k)] for k in range(101)}
    spark.createDataFrame(list(points.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = rows(queries.embedding_cosine_topk(spark, str(tmp_path)).select("query_id", "rank"))
    assert got == sorted([(q, r) for q in range(0, 101, 20) for r in (1, 2, 3)], key=str)
    some = spark.read.parquet(str(tmp_path / "embeddings.parquet")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    assert rows(vectors.dense_cosine_topk(some, some, 3, block=30)) == rows(vectors.dense_cosine_topk(some, some, 3))
    assert vectors.dense_cosine_topk(some.limit(0), some, 3).count() == 0


def test_parameters_are_checked(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5)], "source string, target string, score double")
    with pytest.raises(ValueError):
        vectors.similar_edges(pairs, 0)
    with pytest.raises(ValueError):
        vectors.similar_edges(pairs, 3, 1.5)


@pytest.mark.parametrize("text", ["oc", "ooc", "coc", "oocc", "oococ", "c", "o", "occo", "oooccoc"])
def test_tag_issues_against_a_stack(spark, text):
    stack, want = [], []
    for k, c in enumerate(text):
        if c == "o":
            want += [(k, "nested")] if stack else []
            stack.append(k)
        elif stack:
            stack.pop()
        else:
            want.append((k, "orphan"))
    want += [(k, "unclosed") for k in stack]
    events = spark.createDataFrame([("d", k, 1 if c == "o" else -1) for k, c in enumerate(text)], "doc string, pos int, step int")
    assert sorted((r["pos"], r["issue"]) for r in checks.tag_issues(checks.tag_depths(events)).collect()) == sorted(want)


def test_forward_references(spark):
    chunks = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "doc string, pos int, chunk_id string")
    needs = spark.createDataFrame([("d", 0, "b"), ("d", 1, "a"), ("d", 1, "b"), ("d", 1, "x")], "doc string, pos int, target string")
    assert rows(checks.forward_references(needs, chunks)) == [("d", 0, "b"), ("d", 1, "x")]


def test_mentions_keep_repeats_and_find_dangling(spark):
    chunks = spark.createDataFrame([("c1", 0, ["a", "a", "x"]), ("c2", 1, [])], "chunk_id string, chunk_pos int, entities array<string>")
    catalog = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert mentions.mentions(chunks, catalog).count() == 2
    assert rows(mentions.dangling(chunks, catalog)) == [("x",)]


def test_distances_and_relations(spark):
    edges = spark.createDataFrame([("g", "a", "REQUIRES"), ("a", "b", "SIMILAR"), ("g", "b", "EVIDENCE"), ("b", "c", "COMPLETED"), ("b", "d", "OTHER")], "source string, target string, relation string")
    found = graph.distances(edges, spark.createDataFrame([("g",)], "node string"))
    assert rows(found) == [("a", 1), ("b", 2), ("d", 4), ("g", 0)]
    assert {r["node"]: r["via"] for r in graph.arriving_relations(edges, found).collect()} == {"g": None, "a": "REQUIRES", "b": "EVIDENCE", "d": "OTHER"}


def test_hops_repeat_edges_between_expanded_nodes(spark):
    edges = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "c")], "source string, target string")
    reached = graph.hops(edges, spark.createDataFrame([("s",)], "node string"), 2)
    assert rows(reached) == [("a", 1), ("b", 2), ("s", 0)]
    assert rows(graph.hop_edges(edges, reached, 2)) == [("a", "b"), ("s", "a"), ("s", "a")]


SKILLS = [(0, "parse", ["raw"], ["parsed"], "low", False), (1, "match", ["parsed"], ["gap"], "medium", False), (2, "plan", ["gap", "NOT stop"], ["goal"], "high", False), (3, "skip", ["raw"], ["noise"], "low", True)]
SKILL_TYPE = "pos long, name string, preconditions array<string>, postconditions array<string>, cost string, idempotent boolean"
SESSION_TYPE = "session_id long, goal string, active array<string>, completed array<string>"


def test_plans_and_traces(spark):
    skills = spark.createDataFrame(SKILLS, SKILL_TYPE)
    sessions = spark.createDataFrame([(1, "goal", ["raw"], []), (2, "goal", ["raw", "goal"], []), (3, "goal", ["raw", "stop"], []), (4, "goal", ["gap"], [])], SESSION_TYPE)
    got = {r["session_id"]: r["path"] for r in planning.plans(sessions, skills, 5).collect()}
    assert got == {1: ["parse", "match", "plan"], 2: [], 4: ["plan"]}
    paths = spark.createDataFrame([(1, ["raw", "gap"], ["parse", "match"])], "session_id long, active array<string>, path array<string>")
    assert rows(planning.step_traces(paths, skills)) == [(1, 0, "parse", "parsed", ""), (1, 1, "match", "", "gap")]


def test_failed_or_done_skills_are_not_candidates(spark):
    skills = spark.createDataFrame(SKILLS, SKILL_TYPE)
    sessions = spark.createDataFrame([(1, "goal", ["raw"], ["parse", "skip"])], SESSION_TYPE)
    assert [r["name"] for r in planning.candidates(sessions, skills).collect()] == ["skip"]


def test_sessions_run_to_their_ends(spark):
    skills = spark.createDataFrame(SKILLS[:3], SKILL_TYPE)
    sessions = spark.createDataFrame([(1, "goal", ["raw"], []), (2, "goal", [], []), (3, "goal", ["goal"], [])], SESSION_TYPE)
    history, end = planning.run_sessions(sessions, skills, 20)
    assert rows(history.select("session_id", "iteration", "name", "result")) == [(1, 1, "parse", "success"), (1, 2, "match", "success"), (1, 3, "plan", "success")]
    assert {r["session_id"]: r["reason"] for r in end.collect()} == {1: "goal_reached", 2: "no_candidates", 3: "goal_reached"}
    assert planning.completed_edges(history).count() == 3


def test_sessions_are_built_from_all_events(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "view", 60.0), (3, 7, "purchase", 90.0), (2, 8, "view", 51.0), (5, 8, "click", 70.0), (6, 8, "view", 50.0), (7, 9, "view", None)], "event_id long, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert rows(queries._sessions(spark, str(tmp_path)).select("session_id", "active")) == [(7, ["view"]), (8, ["click"]), (9, [])]


def test_causal_edges_take_the_first_state(spark):
    catalog = spark.createDataFrame([("p", 0, [], ["x", "y"]), ("c", 1, ["y", "x", "NOT z"], ["z"])], "entity_id string, pos int, preconditions array<string>, postconditions array<string>")
    assert rows(graph.causal_edges(catalog)) == [("c", "p", "REQUIRES", "x"), ("p", "c", "LEADS_TO", "x")]


def test_markdown_export(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nchunks:\n  - id: a:one\n    context: first\n    entities: [entity:x]\n  - id: a:two\n    context: none\nentities:\n  - {id: "entity:x", name: X, type: tool}\n---\nIntro\n<Chunk id="a:one">old</Chunk>\n<Chunk id="a:one">\n new \n</Chunk>\n')
    (tmp_path / "b.md").write_text("no head")
    docs = markdown.read_markdown(spark, str(tmp_path))
    chunks, entities = markdown.export(docs)
    assert [(r["id"], r["content"], r["entities"]) for r in chunks.collect()] == [("a:one", "new", ["entity:x"])]
    assert [(r["id"], r["name"]) for r in entities.collect()] == [("entity:x", "X")]


def test_session_log_and_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "add", "a"), (1, 2, "add", "b"), (1, 3, "remove", "a"), (2, 1, "remove", "c")], "session_id long, seq long, op string, state string")
    assert rows(active_states(log)) == [(1, "b"), (2, "")]
    events = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'view' AS event_type UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'view'")
    events.write.parquet(str(tmp_path / "in"))
    stream = state_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("state_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r["event_type"], r["n"]) for r in spark.table("state_counts").collect()] == [("view", 2)]
