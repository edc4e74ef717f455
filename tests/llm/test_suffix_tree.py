"""The suffix tree against a plain version of it, and its distributions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import suffix_tree as st

WORDS = "ba de fi go hu ka le mi no pu ra se".split()


def plain(rows, depth=st.DEPTH, least=st.GAIN):
    """Token rows, scores and the distribution after any words, by dictionaries."""
    texts = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    learn = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 10]
    count = Counter(tuple(t[k : k + n]) for t in learn for n in range(1, depth + 1) for k in range(len(t) - n + 1))
    words = {g[0]: c for g, c in count.items() if len(g) == 1}
    root = st.Root(sum(words.values()), len(words), sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()))
    alone = lambda w: float(root.probability(np.array([words.get(w, 0)]))[0])
    after = defaultdict(dict)
    for g, c in count.items():
        if len(g) > 1:
            after[g[:-1]][g[-1]] = c
    free = {}
    for context, follow in after.items():
        whole = count[context]
        t = whole - sum(c - 1 for c in follow.values())
        gain = 0.0
        for w, c in follow.items():
            q = alone(w) if len(context) == 1 else count[(*context[1:], w)] / count[context[1:]]
            gain += c * math.log((c - 1 + (t + st.PRIOR) * q) / ((whole + st.PRIOR) * q)) if c > 1 else math.log((t + st.PRIOR) / (whole + st.PRIOR))
        if whole > 1 and gain >= least:
            free[context] = t

    def tell(before, w):
        p = alone(w)
        for n in range(1, depth):
            context = tuple(before[len(before) - n :]) if len(before) >= n else None
            if context in free:
                p = (max(after[context].get(w, 0) - 1, 0) + (free[context] + st.PRIOR) * p) / (count[context] + st.PRIOR)
        return p

    out = []
    for i, t in texts:
        base = sum(math.log10((words.get(w, 0) + 0.1) / (root.tokens + 0.1 * (root.types + 1))) for w in t)
        out.append((i, len(t), sum(w in words for w in t), root.tokens, base, sum(math.log10(tell(t[:k], w)) for k, w in enumerate(t))))
    return out, words, free, tell


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", "x", "y"]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    phrase = "se ra pu no mi le ka hu"
    out += [(100 + k, f"{phrase} {rng.choice(WORDS)} {phrase.upper()}") for k in range(12)]
    return out + [(200, None), (201, ""), (202, " \n"), (7, out[7][1]), (None, phrase), (203, "un\u00e9known words é " + "long" * 500)]


def test_scores_against_a_plain_version(spark, rows, monkeypatch):
    want, _, free, _ = plain(rows)
    assert {len(c) for c in free} == {1, 2}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    for block, bucket in ((st.BLOCK_BYTES, st.BUCKET_TOKENS), (700, 150)):
        monkeypatch.setattr(st, "BLOCK_BYTES", block)
        monkeypatch.setattr(st, "BUCKET_TOKENS", bucket)
        got = st.score_documents(docs).collect()
        key = lambda x: [(str(a), b, c, d, round(e, 6), round(f, 6)) for a, b, c, d, e, f in x]
        assert sorted(key([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got])) == sorted(key(want))
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in got)


def test_each_state_is_a_distribution(rows):
    _, words, free, tell = plain(rows)
    for context in [(), *free]:
        assert abs(sum(tell(list(context), w) for w in words) + tell(list(context), "never seen") - 1) < 1e-9


def test_divergence_keeps_what_tells_and_drops_what_does_not():
    number, share, whole = np.array([6, 2, 2]), np.array([0.01, 0.5, 0.5]), np.array([6.0, 4.0])
    free, gain = st.divergence(np.array([0, 1, 1]), number, share, whole)
    assert free.tolist() == [1.0, 2.0] and gain[0] > st.GAIN > gain[1]
    assert abs(gain[0] - 6 * math.log((5 + 6 * 0.01) / (11 * 0.01))) < 1e-9


def test_defined_cases(spark, rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert st.score_documents(none).count() == 0
    held = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10 == 0]
    got = st.score_documents(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert len(got) == len(held) and {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in got} == {(0, 0, 0.0, 0.0)}


def test_packing():
    for values in (np.zeros(0), np.array([0]), np.array([3, 1, 2**40 + 5, 255, 256])):
        assert st.unpack(st.pack(values)).tolist() == values.tolist()
    assert st.unsteps(st.steps(np.array([5, 9, 2**63], np.uint64))).tolist() == [5, 9, 2**63]
