"""Pairs of near texts against all pairs: copies, blocks, ends without a document or a place."""

import random

from weftgraph.operators import checks, near


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc string, pos long, text string")
    return sorted((r["doc"], r["a"], r["b"], round(r["similarity"], 9)) for r in checks.near_pairs(df).collect())


def test_pairs_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for doc in ("d", "e"):
        for _ in range(25):
            base = [names[min(rng.randrange(300), rng.randrange(300))] for _ in range(rng.choice((1, 3, 10, 60)))]
            for _ in range(4):
                kept = [w for w in base if rng.random() > 0.12] + [rng.choice(names) for _ in range(len(base) // 10)]
                rows.append((doc, len(rows), " ".join(kept)))
        rows += [(doc, len(rows) + k, rows[-7][2]) for k in range(5)]
    rows += [("d", 900, None), ("d", 901, "an a"), (None, 902, rows[0][2]), ("d", None, rows[0][2])]
    want = []
    sets = [(d, p, {w for w in (t or "").split() if len(w) > 2}) for d, p, t in rows if d is not None and p is not None]
    for d, p, x in sets:
        for e, q, y in sets:
            if d == e and p < q and x and y and len(x & y) / len(x | y) >= 0.6:
                want.append((d, p, q, round(len(x & y) / len(x | y), 9)))
    assert len(want) > 150
    assert pairs_of(spark, rows) == sorted(want)
    monkeypatch.setattr(near, "BLOCK", 20)
    monkeypatch.setattr(near, "PAIRS", 50)
    assert pairs_of(spark, rows) == sorted(want)
    assert pairs_of(spark, rows[:1]) == []


def test_whole_sets_go_only_to_pairs_that_may_be_near(spark):
    rng = random.Random(11)
    rows = [("d", k, " ".join(["common", f"shared{'abcdefghij'[k % 10]}", *("".join(rng.choice("klmnopqrst") for _ in range(8)) for _ in range(12))])) for k in range(200)]
    sets = near.word_sets(spark.createDataFrame(rows, "doc string, pos long, text string"))
    assert near.near_sets(sets, 0.6).count() == 0
