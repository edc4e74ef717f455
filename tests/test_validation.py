"""Every structural rule on one hand-made export, and on its edges."""

import json

from weftgraph.operators import validation as V

HEAD = {
    "entities": [
        {"id": "entity:s", "name": "S", "type": "state"},
        {"id": "entity:t", "name": "T", "type": "tool", "preconditions": ["NOT entity:s", "entity:t", "entity:gone", 3], "cost": "dear", "idempotent": "yes"},
        {"id": "entity:s", "name": "S2", "type": "state", "postconditions": "entity:s"},
        "odd",
        {"id": "entity:n", "type": "alien"},
        {"id": "entity:u", "name": "U", "type": "alien", "cost": "low", "idempotent": False},
    ],
    "chunks": [
        {"id": "x:1", "context": "c", "entities": ["entity:s", "entity:n", "entity:gone", 4], "created_at": "2024-02-30", "version": 0, "priority": "urgent", "dependencies": ["x:1", "x:2", 5]},
        {"id": "x:2", "entities": "entity:s", "created_at": "2024-01-31", "version": True, "priority": "critical", "dependencies": "x:1", "type": "pdf", "content_path": "a"},
        {"context": "no id"},
        {"id": "x:2", "context": "c", "version": "2", "dependencies": ["x:1"], "type": "image", "content_path": "lost.png", "state_refs": ["entity:t"]},
        {"id": "x:3", "context": "c", "type": "video", "content_path": "here.mp4", "created_at": 20240101, "version": 2},
    ],
}
BODY = '<Chunk id="x:1">\none\n<Chunk id="x:9">\n</Chunk>\n</Chunk>\n</Chunk>\n<Chunk id="x:1"><Chunk id="x:2"></Chunk>'


def rows(df):
    return sorted((r["line"], r["rule"], r["subject"] or "") for r in df.collect())


def test_heads(spark):
    docs = spark.createDataFrame([("d", json.dumps(HEAD))], "doc string, head string")
    media = spark.createDataFrame([("d", "here.mp4")], "doc string, content_path string")
    assert rows(V.head_issues(docs, media)) == sorted([
        (3, "preconditions_no_state", "entity:t"), (3, "preconditions_unknown", "entity:gone"), (3, "preconditions_not_text", "entity:t"), (3, "bad_cost", "entity:t"), (3, "bad_idempotent", "entity:t"),
        (4, "duplicate_entity", "entity:s"), (4, "postconditions_not_list", "entity:s"), (5, "entity_no_object", "4"), (6, "entity_lacks_field", "5"), (7, "unknown_type", "entity:u"),
        (2, "entity_undefined", "entity:gone"), (2, "entity_no_text", "x:1"), (2, "bad_created_at", "x:1"), (2, "bad_version", "x:1"), (2, "bad_priority", "x:1"), (2, "dependency_not_found", "x:2"), (2, "dependency_not_text", "x:1"),
        (3, "no_context", "x:2"), (3, "entities_no_list", "x:2"), (3, "dependencies_not_list", "x:2"), (3, "bad_media_type", "x:2"), (3, "path_of_text", "x:2"),
        (4, "chunk_lacks_id", "3"), (5, "duplicate_chunk", "x:2"), (5, "bad_version", "x:2"), (5, "path_missing", "x:2"), (5, "state_refs_no_state", "entity:t"), (6, "bad_created_at", "x:3"),
    ])


def test_heads_that_hold_nothing(spark):
    docs = spark.createDataFrame([("none", None), ("broken", "{"), ("empty", "{}"), ("odd", '{"entities": 1, "chunks": []}')], "doc string, head string")
    assert sorted((r["doc"], r["rule"], r["severity"]) for r in V.head_issues(docs).collect()) == [("broken", "no_head", "warning"), ("empty", "no_chunks", "warning"), ("none", "no_head", "warning"), ("odd", "entities_not_list", "error")]
    assert V.head_issues(docs.limit(0)).count() == 0


def test_bodies(spark):
    docs = spark.createDataFrame([("d", json.dumps(HEAD), BODY, 10), ("e", None, "</chunk> <Chunk id='a'>", 1)], "doc string, head string, body string, first_line int")
    got = V.body_issues(docs)
    assert rows(got.filter("doc = 'd'")) == sorted([(12, "undefined_tag", "x:9"), (16, "duplicate_tag", "x:1 first 10"), (6, "unused_chunk", "x:3"), (12, "nested_tag", "x:1 > x:9"), (15, "orphan_close", ""), (16, "nested_tag", "x:1 > x:2"), (16, "unclosed_tag", "x:1")])
    # on one line the open comes before the close
    assert rows(got.filter("doc = 'e'")) == []
    counted = {r["doc"]: (r["errors"], r["warnings"], r["infos"]) for r in V.severities(got).collect()}
    assert counted == {"d": (6, 1, 0)}


def test_heads_in_pieces_have_the_issues_of_the_whole(spark, monkeypatch, tmp_path):
    import json

    from weftgraph import queries

    entities = [{"id": f"e{k % 3}", "name": "N", "type": ("state", "alien")[k % 2]} if k != 2 else 7 for k in range(5)]
    chunks = [{"id": f"c{k % 3}", "version": k, "dependencies": [f"c{k + 1}"], "entities": ["e0", "gone"], "state_refs": ["e1"]} for k in range(5)]
    whole = spark.createDataFrame([("d", json.dumps({"entities": entities, "chunks": chunks})), ("n", None)], "doc string, head string")
    pieces = [("d", json.dumps({"entities": entities[k : k + 2], "chunks": chunks[k : k + 2]}), k) for k in (4, 0, 2)] + [("n", None, 0)]
    assert rows(V.head_issues(spark.createDataFrame(pieces, "doc string, head string, before int"))) == rows(V.head_issues(whole))
    monkeypatch.setattr(queries, "HEAD_PIECE", 7)
    spark.createDataFrame([(k, "Brand#1", k % 5) for k in range(1, 31)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    held = sorted((r["before"], len(json.loads(r["head"])["chunks"])) for r in queries._heads(spark, str(tmp_path)).collect())
    assert held == [(0, 7), (7, 7), (14, 7), (21, 7), (28, 2)]
