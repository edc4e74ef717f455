"""Quality by ordinal cumulative-link regression on graded ratings.

The log odds that a text's grade is at least k are a score of the text less a threshold for k: the score's weights are shared
by all grades, the thresholds are ordered. The score is linear in hashed features, each a share of the text's words: words,
their shapes (letters, digits and signs by kind), and how many of the words or lines stand in the text before. Expected grade and the
probability of a grade of at least ``keep_from`` follow; selection takes texts by that tail probability.

Weights are learnt on a bounded sample of rated rows, those of the smallest hashed ids whose texts are neither null nor of more
than ``SAMPLE_TEXT_BYTES``; scoring is one pass without a shuffle.

Defined cases: a null or empty text has no features, its score is that of a text at 0; with ratings of fewer than two grades
every text gets the one known grade, or 0; null ids are held out; repeated rows score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_row, learnt, slices, span_hashes, word_bounds
from .suffix_tree import held_out

#: Most rated rows that training sees.
SAMPLE_ROWS = 4000
#: Rated texts of more bytes are not learnt from, as the sample is one of whole texts; they are scored like all others.
SAMPLE_TEXT_BYTES = 1 << 18
BITS = 11
STEPS = 400
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
EXTRA = 4


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each word and of its shape; the number of words of each row; and a few features of whole rows."""
    starts, ends, counts = word_bounds(data, offsets)
    word = span_hashes(LOWER[data], starts, ends)
    shape = span_hashes(_SHAPE[data], starts, ends)
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    distinct = np.bincount((np.unique(rows << np.uint64(44) | word >> np.uint64(20)) >> np.uint64(44)).astype(np.int64), minlength=len(counts))
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(data)], breaks + 1, [len(data)]]))
    lines = span_hashes(data, edges[:-1], edges[1:])
    of = np.searchsorted(offsets, edges[:-1], side="right").astype(np.uint64) - np.uint64(1)
    n_lines = np.bincount(of.astype(np.int64), minlength=len(counts))
    n_distinct = np.bincount((np.unique(of << np.uint64(44) | lines >> np.uint64(20)) >> np.uint64(44)).astype(np.int64), minlength=len(counts))
    size = np.maximum(counts, 1)
    whole = np.column_stack([1 - distinct / size, 1 - n_distinct / np.maximum(n_lines, 1), np.log1p(counts) / 10, by_row(ends - starts, counts) / size / 10])
    mask = np.uint64((1 << BITS) - 1)
    return (word & mask).astype(np.int64), (shape & mask).astype(np.int64) + (1 << BITS), counts, whole


def dense(texts: list[str]) -> np.ndarray:
    out = []
    for _, data, offsets in slices(pa.record_batch([pa.array(texts, pa.string())], ["text"])):
        word, shape, counts, whole = feature_rows(data, offsets)
        rows, x = np.repeat(np.arange(len(counts)), counts), np.zeros((len(counts), (2 << BITS) + EXTRA), np.float32)
        share = np.repeat(1 / np.maximum(counts, 1), counts)
        np.add.at(x, (rows, word), share)
        np.add.at(x, (rows, shape), share)
        x[:, 2 << BITS :] = whole
        out.append(x)
    return np.vstack(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """Shared weights and ordered thresholds of the grades in ``grades``."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Probability of at least grades[1], grades[2], ... for each score."""
        return sigmoid(score[:, None] - self.thresholds)

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(score), float(self.grades[0]))

    def at_least(self, score: np.ndarray, grade: int) -> np.ndarray:
        k = sum(g < grade for g in self.grades)
        return np.ones(len(score)) if k == 0 else np.zeros(len(score)) if k == len(self.grades) else self.tails(score)[:, k - 1]


def fit(x: np.ndarray, ratings: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam; gaps between thresholds are exponentials, so that they stay ordered."""
    grades = sorted(set(ratings.tolist())) or [0]
    if len(grades) < 2:
        return Ordinal(grades, np.zeros((2 << BITS) + EXTRA), np.zeros(0))
    rank = np.searchsorted(grades, ratings)
    k = len(grades) - 1
    share = np.array([(rank > j).mean() for j in range(k)])
    start = np.log((1 - share) / share)
    theta = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    w = np.zeros(x.shape[1])
    params = np.concatenate([w, theta])
    m, v = np.zeros(len(params)), np.zeros(len(params))
    for t in range(1, steps + 1):
        w, theta = params[: x.shape[1]], params[x.shape[1] :]
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = x @ w.astype(np.float32)
        p = np.hstack([np.ones((len(s), 1)), sigmoid(s[:, None] - cuts), np.zeros((len(s), 1))])
        at = np.arange(len(s))
        mass = np.maximum(p[at, rank] - p[at, rank + 1], 1e-9)
        slope = p * (1 - p)
        ds = -(slope[at, rank] - slope[at, rank + 1]) / mass / len(s)
        dcut = np.zeros(k)
        for j in range(k):  # cut j bounds the mass of ranks j and j + 1
            dcut[j] = ((np.where(rank == j + 1, 1, 0) - np.where(rank == j, 1, 0)) * slope[:, j + 1] / mass).sum() / len(s)
        back = np.cumsum(dcut[::-1])[::-1]
        grad = np.concatenate([x.T @ ds.astype(np.float32) + decay * w, back[:1], back[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.3 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, theta = params[: x.shape[1]], params[x.shape[1] :]
    return Ordinal(grades, w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def rated_sample(docs: DataFrame, ratings: DataFrame, parts: int, most: int) -> DataFrame:
    """text and grade of at most ``most`` rated rows that aren't held out, in an order of their own; texts of more than SAMPLE_TEXT_BYTES are passed over."""
    known = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").isNotNull() & ~held_out(F.col("doc_id"), parts)).select("doc_id", "grade").distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(F.broadcast(picked), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "grade").limit(most).select("text", "grade")


def model_of(rows: Iterator[dict]) -> Ordinal:
    """The model of rated rows; each text is let go once its features are counted."""
    x, grades = [], []
    for r in rows:
        x.append(dense([r["text"]])[0])
        grades.append(int(r["grade"]))
    return fit(np.stack(x) if x else np.zeros((0, (2 << BITS) + EXTRA), np.float32), np.array(grades, np.int64))


def score_quality(docs: DataFrame, ratings: DataFrame, keep_from: int = 1, parts: int = 5, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, expected_grade, tail (probability of a grade of keep_from or more) and keep of each row. ratings: doc_id, grade."""
    model = learnt(rated_sample(docs, ratings, parts, most), model_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.weights
        for batch in batches:
            for part, data, offsets in slices(batch):
                word, shape, counts, whole = feature_rows(data, offsets)
                score = by_row(w[word] + w[shape], counts) / np.maximum(counts, 1) + whole @ w[2 << BITS :]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.expected(score)), pa.array(model.at_least(score, keep_from))], ["doc_id", "expected_grade", "tail"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail double")
    return scored.select("doc_id", held_out(F.col("doc_id"), parts).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("keep"))


def grades(quality: Column, toxic: Column) -> Column:
    """A graded rating of two marks: 0 poor, 1 good but toxic, 2 good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)
