"""The search of near copies by band keys against all pairs of fingerprints."""

import random

import numpy as np

from weftgraph.llm import fingerprints as fp

WORDS = "ba de fi go hu ka le mi no pu ra se ti vo wa xe yo zu an el".split()


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice(["", "q", "zz"])
    return "".join(out)


def test_search_against_all_pairs(spark):
    rng = random.Random(17)
    rows = []
    for size in (30, 80, 300):
        for _ in range(6):
            base = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(size))
            rows += [(len(rows) + k, edited(rng, base, k * max(1, size // 60))) for k in range(5)]
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "short"), (504, "short"), (7, rows[7][1]), (None, rows[3][1])]
    prints = fp.embed([fp.points(t or "") for _, t in rows])
    group = list(range(len(rows)))
    pairs = linked = 0
    got = {}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = fp.near_copies(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        got[r["fingerprint"], r["doc_id"]] = r["class_id"]
    for a in range(len(rows)):
        for b in range(a):
            if prints[a] and prints[b] and fp.likeness(prints[a], prints[b]) >= fp.NEAR:
                group = [group[b] if g == group[a] else g for g in group]
                pairs += 1
                linked += got[prints[a], rows[a][0]] == got[prints[b], rows[b][0]]
    assert pairs > 60 and linked >= 0.9 * pairs
    # what is of one class is of one group of all pairs too
    members = {}
    for k, (i, _) in enumerate(rows):
        if prints[k]:
            members.setdefault(got[prints[k], i], set()).add(group[k])
    assert all(len(g) == 1 for g in members.values())
    assert got["", 501] == 501 and got["", 502] == 502 and fp.near_copies(docs.limit(0)).count() == 0


def test_likeness_is_told_by_plain_counting():
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    a, b = fp.embed([fp.points(base), fp.points(edited(rng, base, 4))])
    total = same = 0.0
    for x, y in zip(a.split("."), b.split("."), strict=True):
        for k in range(max(len(x), len(y))):
            weight = 1.0 if k < fp.SAMPLES else 2.0 ** (k // fp.SAMPLES - 1)
            total += weight
            same += weight * (k < min(len(x), len(y)) and x[k] == y[k])
    assert abs(fp.likeness(a, b) - max(0.0, (same / total - 1 / 16) / (15 / 16))) < 1e-12


def test_marks_lose_no_near_pair_and_tell_most_others():
    rng = random.Random(23)
    texts = []
    for size in (3, 12, 50, 200, 900):
        base = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(size))
        texts += [edited(rng, base, k * max(1, size // 40)) for k in range(6)] + [base[: len(base) * 9 // 10]]
        texts += [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(size)) for _ in range(3)]
    prints = [x for x in fp.embed([fp.points(t) for t in texts]) if x]
    told = np.array([fp.marks(x) for x in prints], np.int64)
    a, b = np.triu_indices(len(prints), 1)
    good = fp.may_be_near(told, a, b, fp.NEAR)
    near = np.array([fp.likeness(prints[x], prints[y]) >= fp.NEAR for x, y in zip(a, b, strict=True)])
    assert near.sum() > 20 and not (near & ~good).any()
    assert good.sum() < 2 * near.sum()
