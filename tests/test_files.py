"""Sources and sinks of whole documents."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.sources import files

EXPORT = {"entities": [{"id": "entity:a", "name": "A", "type": "tool"}], "chunks": [{"id": "x:1", "context": "c", "content": "t", "tags": ["u"], "entities": ["entity:a"], "version": 2}, {"id": "x:2", "content": "t"}]}


def lines(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]


def test_documents_are_told_apart(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(EXPORT, indent=1))
    (tmp_path / "p.json").write_text(json.dumps({"entities": [{"id": "entity:a", "mention_count": 3}]}))
    (tmp_path / "n.json").write_text("{}")
    assert files.read_document(spark, str(tmp_path / "e.json"))[0] == "export"
    kind, profiles = files.read_document(spark, str(tmp_path / "p.json"))
    assert kind == "profiles" and profiles.first()["mention_count"] == 3
    chunks, entities = files.read_export(spark, str(tmp_path / "e.json"))
    assert [(r["id"], r["version"], r["tags"]) for r in chunks.orderBy("pos").collect()] == [("x:1", 2, ["u"]), ("x:2", None, None)] and entities.first()["name"] == "A"
    for read in (files.read_document, files.read_export):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / "n.json"))


def test_states_come_back(spark, tmp_path):
    goals = spark.createDataFrame([("s1", "g", ["a", "a", "b"])], "session_id string, goal string, seed array<string>")
    state = files.new_states(goals, F.lit("2024-01-01").cast("timestamp"))
    files.write_states(state, str(tmp_path / "s"), F.lit("2024-02-01").cast("timestamp"))
    row = files.read_json(spark, str(tmp_path / "s"), files.STATE).first()
    assert (row["active_states"], row["completed_skills"], row["created_at"][:10], row["updated_at"][:10]) == (["a", "b"], [], "2024-01-01", "2024-02-01")
    assert "Goal: g" in files.state_lines(files.read_states(spark, str(tmp_path / "s"))).first()["line"]
    fresh = files.new_states(spark.createDataFrame([("g", [])], "goal string, seed array<string>"))
    assert len(fresh.first()["session_id"]) == 36


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    files.write_document({"chunks": rows, "entities": rows.limit(0)}, str(tmp_path / "d"))
    assert json.loads("".join(lines(tmp_path / "d"))) == {"chunks": [{"id": 1, "text": "a"}, {"id": 2}], "entities": []}
    files.write_document({"chunks": rows}, str(tmp_path / "pretty"), pretty=True)
    assert len(lines(tmp_path / "pretty")) > 3
    files.write_graph(rows, rows, str(tmp_path / "g"), rows.withColumn("relation", F.lit("COMPLETED")))
    assert len(lines(tmp_path / "g" / "edges")) == 4
    end = spark.createDataFrame([("s", "goal_reached")], "session_id string, reason string")
    files.write_run(rows, end, str(tmp_path / "run"))
    assert json.loads(lines(tmp_path / "run" / "result")[0])["goal_reached"] is True
    files.write_slug_outputs(rows, rows, rows, rows, str(tmp_path / "k8"))
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load("\n".join(lines(tmp_path / "k8" / "queries")))[0] == {"id": 1, "query": "a"}


def test_reports(spark):
    ranked = spark.createDataFrame([("q", "a", 1, 0.5), ("q", "b", 2, 0.25)], "query_id string, id string, rank long, score double")
    queries = spark.createDataFrame([("q", "what"), ("r", "none")], "id string, text string")
    relevant = spark.createDataFrame([("q", "b")], "query_id string, id string")
    got = [r["line"] for r in files.retrieval_report(ranked, queries, relevant).orderBy("query_id", "at").collect()]
    assert got == ["## q: what", "  1. a (0.500)", "  2. b (0.250) *", "recovered 1 of 3", "## r: none", "recovered 0 of 3"]
    issues = spark.createDataFrame([("d", "empty", "error", "x:1", "no context", "write one", {"context": "?"})], "doc string, rule string, severity string, subject string, message string, suggestion string, fix map<string,string>")
    texts = [files.issue_report(issues, level).first()["value"] for level in ("diagnose", "suggest", "fix")]
    assert texts[0] == "[ERROR] d x:1 no context" and texts[1].endswith("suggestion: write one") and texts[2].endswith('fix: {"context":"?"}')
    assert "suggestion" not in json.loads(files.issue_report(issues, as_json=True).first()["value"])
    with pytest.raises(ValueError):
        files.issue_report(issues, "all")


def test_contexts_and_tokens(spark):
    chunks = spark.createDataFrame([("d", "x:1", "body", "whole")], "doc string, id string, content string, text string")
    assert files.situated(chunks).first()["context"] == "[DRY RUN] Context for x:1"
    calls = files.situated(chunks, lambda doc, chunk: (f"{chunk} of {doc}", 30, 5, 70))
    assert calls.first()["context"] == "body of whole"
    assert tuple(files.token_usage(calls).first()) == (30, 5, 70, 1, 70.0) and files.token_usage(calls.limit(0)).first()["saved"] is None
    docs = spark.createDataFrame([("p", '<Chunk id="x:1">\nbody\n</Chunk>')], "path string, text string")
    assert files.contextualized(docs).first()["text"] == '<Chunk id="x:1">\n<!-- Context: [DRY RUN] Context for x:1 -->\n\nbody\n</Chunk>'


def test_sections_names_and_keywords(spark):
    docs = spark.createDataFrame([("p", "intro\n## a\n" + "w " * 120 + "\n---\nrest\n### b\nx")], "path string, text string")
    assert [(r["words"], r["band"]) for r in files.header_sections(docs).orderBy("pos").collect()] == [(1, "tiny"), (122, "small"), (1, "tiny"), (3, "tiny")]
    ids = spark.createDataFrame([("A", "entity:a"), ("B", "entity:b")], "name string, id string")
    rows = spark.createDataFrame([("A", "B"), ("A", "C")], "source string, target string")
    assert [(r["source_id"], r["target_id"]) for r in files.name_dimension(rows, ids).collect()] == [("entity:a", "entity:b")]
    assert spark.range(1).select(T.long_tokens(F.lit("You can use Spark with go and SQL-likes sql")).alias("t")).first()["t"] == ["spark", "sql-likes", "sql"]
