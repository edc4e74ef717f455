"""Nearest dense vectors against brute force: copies, blocks, vectors of zeros and rows without a vector."""

import math
import random

import numpy as np

from weftgraph import queries
from weftgraph.operators import vectors


def brute(rows, k):
    out = []
    for q, x in rows:
        scored = []
        for i, y in rows:
            if i == q:
                continue
            size = 0.0 if x is None or y is None else math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
            score = None if x is None or y is None else math.inf if size == 0 else round(sum(a * b for a, b in zip(x, y, strict=True)) / size, 9)
            scored.append((score is None, -(score or 0.0), i))
        out += [(q, i, n + 1) for n, (_, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_every_row_is_a_query(spark, tmp_path):
    points = {k: [math.cos(k * k), math.sin(k * k), math.cos(3 * k)] for k in range(101)}
    spark.createDataFrame(list(points.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.embedding_cosine_topk(spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, r) for q in range(101) for r in (1, 2, 3)]


def test_blocks_copies_and_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(60, 90)] + [(90, [0.0] * 5), (91, None), (92, None), (93, [0.0] * 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = brute(rows, 3)
    for block in (1 << 15, 30, 7):
        got = sorted((r["query_id"], r["id"], r["rank"]) for r in vectors.dense_cosine_topk(df, df, 3, block=block).collect())
        assert got == want
    some = df.filter("id % 10 = 0")
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in vectors.dense_cosine_topk(some, df, 3).collect()) == [r for r in want if r[0] % 10 == 0]
    assert vectors.dense_cosine_topk(df.limit(0), df, 3).count() == 0


def test_tiles_sift_without_loss():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 8))
    v[1000:1400] = v[5]
    ids = rng.permutation(3000)
    given = np.ones(3000, bool)
    rows, at, _ = vectors.cell_topk(ids, v, given, ids, v, given, 3, tile=(256, 512))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -2)
    got = {}
    for q, a in zip(rows.tolist(), at.tolist(), strict=True):
        got.setdefault(q, set()).add(a)
    for q in range(0, 3000, 37):
        assert got[q] == set(np.lexsort((ids, -score[q]))[:3].tolist())
