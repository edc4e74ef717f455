"""The slug catalogue of lessons: nulls, repeats, ends without an entity, empty tables."""

from weftgraph.operators import catalog

LESSONS = "chunk_id string, title string, text string, skills array<string>, prerequisites array<string>"
ROWS = [
    ("a", "A", "graphs and graphs of walks", ["Node.js", "SQL"], ["Shell"]),
    ("b", "B", "walks", ["node js", None, "SQL", "SQL"], None),
    ("c", "C", None, None, ["Shell", "Rare"]),
]


def test_entities_edges_and_profiles(spark):
    lessons = spark.createDataFrame(ROWS, LESSONS)
    names = catalog.named(lessons)
    known = spark.createDataFrame([("entity:shell",), ("entity:unseen",)], "entity_id string")
    found = catalog.entity_catalog(names, known, least=3)
    assert {(r["entity_id"], r["mentions"]) for r in found.collect()} == {("entity:sql", 3), ("entity:shell", 2)}
    stated = spark.createDataFrame([("SQL", "Shell", "requires"), ("Shell", "sql", "relatedTo"), ("SQL", "Rare", "requires"), ("SQL", "Nowhere", "requires")], "source string, target string, relation string")
    assert [tuple(r) for r in catalog.catalog_edges(stated, names, found).collect()] == [("entity:shell", "entity:sql", 0.85)]
    assert [tuple(r) for r in catalog.catalog_edges(stated.limit(0), names, found).collect()] == [("entity:shell", "entity:sql", 0.70)]
    assert {(r["entity_id"], r["skill"], r["n"], r["rank"]) for r in catalog.co_skills(names, found).collect()} == {
        ("entity:sql", "node js", 2, 1),
        ("entity:sql", "Node.js", 1, 2),
        ("entity:shell", "Node.js", 1, 1),
        ("entity:shell", "SQL", 1, 2),
    }
    tokens = {(r["entity_id"], r["token"], r["n"]) for r in catalog.lesson_keywords(lessons, names, found).collect()}
    assert tokens == {("entity:sql", "walks", 3), ("entity:sql", "graphs", 2), ("entity:shell", "walks", 1), ("entity:shell", "graphs", 2)}


def test_empty_tables(spark):
    lessons = spark.createDataFrame([], LESSONS)
    names = catalog.named(lessons)
    found = catalog.entity_catalog(names)
    assert found.count() == 0 and catalog.co_skills(names, found).count() == 0 and catalog.lesson_keywords(lessons, names, found).count() == 0
