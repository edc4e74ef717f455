"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares words by the symbol triples that both hold in order, gaps allowed: a triple counts DECAY to the power of
its span, a letter that it skips costs a full step and an inserted sign a quarter, so ``i.d.i.o.t`` is near ``idiot``; runs of
single characters are read as one word too. Word ends are symbols. Values are scaled by the words' own norms.

Training sees the sentences of a bounded sample of labelled documents. A sentence is judged by its most toxic word, its
witness: witnesses of clean documents' sentences are negatives, the best of each toxic document's sentences positives, and
witnesses and machine are found in turns. The machine works on Nyström features of landmark words. As those are linear in
the landmarks' triples, a learnt machine is one weight for each triple, and scoring a word is a sum of table entries. A
document's evidence (its best word, how many words lie on the toxic side, its length) is calibrated to a probability.

Words are scored once for each slice of text and kept for the task. Nothing is shuffled.

Defined cases: a null or empty text scores as a document without evidence; without labelled texts of both kinds that have
words every score is the share of toxic labels, or 0; null ids are held out; repeated rows score alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import by_row, learnt, slices, span_hashes, word_bounds

#: The most labelled documents of each kind that training sees, and their most bytes; longer ones are passed over, as the sample is one of documents.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1000, 2000, 8 << 20
LANDMARKS = 160
ROUNDS = 4
DECAY, SIGN_STEP, SPAN = 0.5, 0.25, 6
ALPHABET = 48
CACHE_WORDS = 1_000_000


def symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, place on the gap scale and word of each letter, digit and word end of the words."""
    text = b"\n".join(words).decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    points = np.concatenate([[10], points, [10]])
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    letter, digit, end = (points >= 97) & (points <= 122), (points >= 48) & (points <= 57), points == 10
    other = points >= 128
    kind = np.where(letter, points - 96, np.where(digit, 45, np.where(other, 27 + points % 18, 0)))
    place = np.cumsum(np.where(letter | digit | other | end, 1.0, SIGN_STEP))
    # an end is the last symbol of one word and the first of the next
    word = np.cumsum(end)
    keep = letter | digit | other | end
    kind, place, word = kind[keep], place[keep], word[keep]
    twice = np.where(kind == 0, 2, 1)
    kind, place, word = np.repeat(kind, twice), np.repeat(place, twice), np.repeat(word, twice)
    first = np.append((kind[1:] == 0) & (kind[:-1] == 0) & (place[1:] == place[:-1]), False)
    word = word - first
    return kind[1:-1], place[1:-1], word[1:-1] - 1


def triples(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word, triple and weight of each symbol triple, one pair of distances after another."""
    kind, place, word = symbols(words)
    for b in range(2, SPAN + 1):
        if len(kind) <= b:
            return
        at = np.flatnonzero(word[:-b] == word[b:])
        weight = DECAY ** (place[at + b] - place[at])
        for a in range(1, b):
            yield word[at], (kind[at] * ALPHABET + kind[at + a]) * ALPHABET + kind[at + b], weight


def evaluate(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The scaled product of each word's triples with the weights."""
    if len(words) > 20_000:
        return np.concatenate([evaluate(words[k : k + 20_000], weights) for k in range(0, len(words), 20_000)])
    total, norm = np.zeros(len(words)), np.zeros(len(words))
    for word, triple, weight in triples(words):
        total += np.bincount(word, weight * weights[triple], len(words))
        norm += np.bincount(word, weight * weight, len(words))
    return total / np.sqrt(np.maximum(norm, 1e-12))


def mapped(words: list[bytes]) -> np.ndarray:
    """The scaled triples of some words as columns."""
    out, norm = np.zeros((ALPHABET**3, len(words)), np.float32), np.zeros(len(words))
    for word, triple, weight in triples(words):
        np.add.at(out, (triple, word), weight)
        norm += np.bincount(word, weight * weight, len(words))
    out /= np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)
    return out


def products(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """The scaled products of each word's triples with each column of the table."""
    out, norm = np.zeros((len(words), table.shape[1]), np.float32), np.zeros(len(words))
    for word, triple, weight in triples(words):
        if len(word):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            out[word[first]] += np.add.reduceat(table[triple] * weight[:, None].astype(np.float32), first, axis=0)
            norm += np.bincount(word, weight * weight, len(words))
    return out / np.sqrt(np.maximum(norm, 1e-12))[:, None].astype(np.float32)


def solve_svm(z: np.ndarray, y: np.ndarray, cost: float, steps: int = 30) -> np.ndarray:
    """Squared-hinge support vector machine with balanced classes by Newton steps; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    share = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * cost
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (z @ w) < 1
        a, s = z[inside], share[inside]
        new = np.linalg.solve(ridge + (a * s[:, None]).T @ a, (a * s[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.01 * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.01 * np.eye(len(w)), grad)
    return w


_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def joined_letters(words: list[bytes]) -> list[bytes]:
    """Runs of three or more single characters, each as one word."""
    out, run = [], []
    for w in [*words, b"  "]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                out.append(b"".join(run))
            run = []
    return out


class Machine:
    """Weights of the triples, bias, and the calibration of a document's evidence."""

    def __init__(self, weights: np.ndarray, bias: float, calibration: np.ndarray | None, prior: float):
        self.weights, self.bias, self.calibration, self.prior = weights.astype(np.float32), bias, calibration, prior

    def words(self, words: list[bytes]) -> np.ndarray:
        return evaluate(words, self.weights) + self.bias if words else np.zeros(0)

    def probability(self, best: np.ndarray, hits: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(best), self.prior)
        x = np.column_stack([*evidence(best, hits, size), np.ones(len(best))])
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def evidence(best: np.ndarray, hits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.clip(best, -3, 3), np.log1p(hits), np.log1p(size)


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    """The machine of labelled texts; deterministic."""
    y = np.array(toxic, np.int64)
    empty = np.zeros(ALPHABET**3)
    if not len(y) or not 0 < y.sum() < len(y):
        return Machine(empty, 0.0, None, float(y.mean()) if len(y) else 0.0)
    index: dict[bytes, int] = {}
    sentences: list[np.ndarray] = []
    owner: list[int] = []
    for k, text in enumerate(texts):
        for sentence in _SENTENCE.split((text or "").encode("utf-8", "replace")):
            own = sentence.split()
            own += joined_letters(own)
            if own:
                sentences.append(np.array([index.setdefault(w.lower(), len(index)) for w in own]))
                owner.append(k)
    words, of = list(index), np.array(owner)
    if len(set(y[of].tolist())) < 2:  # one of the kinds has no words
        return Machine(empty, 0.0, None, float(y.mean()))
    flat, begins = np.concatenate(sentences), np.cumsum([0, *map(len, sentences)])[:-1]
    rows = np.repeat(of, [len(s) for s in sentences])
    pairs = np.unique(rows * len(words) + flat)
    held = (np.bincount(pairs % len(words), y[pairs // len(words)], len(words)), np.bincount(pairs % len(words), 1 - y[pairs // len(words)], len(words)))
    score = np.log((held[0] + 0.1) / (y.sum() + 1)) - np.log((held[1] + 0.1) / ((1 - y).sum() + 1))
    score = score * np.sqrt(held[0] + held[1])
    rng = np.random.default_rng(11)
    # landmarks: words that lean to toxic documents most, and words of any kind
    lean = np.argsort(-score, kind="stable")[: landmarks // 2]
    marks = np.unique(np.concatenate([lean, rng.choice(len(words), min(len(words), landmarks - len(lean)), replace=False)]))
    basis = mapped([words[i] for i in marks])
    gram = basis.T @ basis
    values, vectors = np.linalg.eigh(gram.astype(float))
    good = values > 1e-4 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    toxic_sentence = y[of] == 1
    weights, bias = empty, 0.0
    for _ in range(rounds):
        top = np.maximum.reduceat(score[flat], begins)
        # the witness of each sentence: its first word of the highest score
        where = np.flatnonzero(score[flat] == np.repeat(top, np.diff(np.append(begins, len(flat)))))
        witness = flat[where[np.unique(np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(flat))))[where], return_index=True)[1]]]
        order = np.lexsort((-top, of))
        first = order[np.append(True, of[order][1:] != of[order][:-1])]
        positive = np.unique(first[toxic_sentence[first]])
        negative = np.flatnonzero(~toxic_sentence)
        hard = negative[np.argsort(-top[negative], kind="stable")[:4000]]
        negative = np.concatenate([hard, rng.choice(negative, min(len(negative), 4000), replace=False)])
        chosen = np.concatenate([witness[positive], witness[negative], rng.choice(flat[np.isin(rows, np.flatnonzero(y == 0))], 4000)])
        side = np.concatenate([np.ones(len(positive)), -np.ones(len(negative) + 4000)])
        unique, inverse = np.unique(chosen, return_inverse=True)
        z = np.vstack([products([words[i] for i in unique[k : k + 500]], basis) for k in range(0, len(unique), 500)]) @ whiten
        w = solve_svm(z[inverse], side, cost=0.05)
        weights, bias = basis @ (whiten @ w[:-1]).astype(np.float32), w[-1]
        score = evaluate(words, weights) + bias
    size = np.bincount(rows, minlength=len(y))
    best = np.full(len(y), -3.0)
    np.maximum.at(best, rows, score[flat])
    hits = np.bincount(rows, score[flat] > 0, len(y))
    return Machine(weights, bias, logistic(np.column_stack(evidence(best, hits, size)), y.astype(float)), float(y.mean()))


def sample(docs: DataFrame, labels: DataFrame, parts: int, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """text and toxic of a bounded sample of the training rows, the same at each run: the ids of the smallest hashes."""
    from .suffix_tree import held_out

    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), parts)).select("doc_id", "toxic").distinct()
    picked = None
    for kind, most in ((1, toxic_rows), (0, clean_rows)):
        own = known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = own if picked is None else picked.unionByName(own)
    ids = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)
    each = F.octet_length("text") <= SAMPLE_BYTES // 40
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & each).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(toxic_rows + clean_rows)
    return rows.select("text", "toxic")


def machine_of(rows: Iterator[dict]) -> Machine:
    """The machine of the sample's first SAMPLE_BYTES of texts."""
    texts, marks, room = [], [], SAMPLE_BYTES
    for r in rows:
        if (room := room - len(r["text"].encode("utf-8", "replace"))) < 0:
            break
        texts.append(r["text"])
        marks.append(int(r["toxic"]))
    return train(texts, marks)


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5) -> DataFrame:
    """All columns of docs, then held_out, score (0 to 1) and predicted (1 if score >= 0.5) of each row."""
    from .suffix_tree import held_out

    machine = learnt(sample(docs, labels, parts), machine_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for part, data, offsets in slices(batch, "_row.text"):
                starts, ends, counts = word_bounds(data, offsets)
                hashes = span_hashes(data, starts, ends)
                unique, first = np.unique(hashes, return_index=True)
                at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                new = known[at] != unique if len(known) else np.ones(len(unique), bool)
                if new.any():
                    raw = data.tobytes()
                    found = machine.words([raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
                    if len(known) > CACHE_WORDS:  # what this slice needs again is scored again
                        keep = np.isin(known, unique)
                        known, scores = known[keep], scores[keep]
                    into = np.searchsorted(known, unique[new])
                    known, scores = np.insert(known, into, unique[new]), np.insert(scores, into, found)
                score = scores[np.searchsorted(known, hashes)] if len(hashes) else np.zeros(0)
                rows = np.repeat(np.arange(len(counts)), counts)
                best, hits = np.full(len(counts), -3.0), by_row(score > 0, counts).astype(float)
                np.maximum.at(best, rows, score)
                single = (ends - starts == 1).astype(np.int8)
                if len(single) > 2 and (single[2:] & single[1:-1] & single[:-2]).any():
                    raw, edge = data.tobytes(), np.concatenate([[0], np.cumsum(counts)])
                    spelt = single[2:] & single[1:-1] & single[:-2]
                    for r in np.unique(rows[:-2][spelt.astype(bool)]).tolist():
                        runs = joined_letters([raw[a:b] for a, b in zip(starts[edge[r] : edge[r + 1]].tolist(), ends[edge[r] : edge[r + 1]].tolist(), strict=True)])
                        if runs:
                            extra = machine.words(runs)
                            best[r], hits[r] = max(best[r], extra.max()), hits[r] + (extra > 0).sum()
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(machine.probability(best, hits, counts))], ["_row", "score"])

    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"], F.col("text")).alias("_row"))
    scored = packed.mapInArrow(run, StructType([*packed.schema, StructField("score", DoubleType())]))
    own = [F.col(f"_row.`{c}`").alias(c) for c in columns if c not in ("held_out", "score", "predicted")]
    return scored.select(*own, held_out(F.col("_row.doc_id"), parts).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
