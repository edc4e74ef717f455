"""Benchmark decontamination: pairs of words find passages, Smith-Waterman alignment scores them.

Words are runs of letters, digits and non-ASCII characters, A to Z in lower case. An item is aligned with the words around
its hits: a match counts 1, a mismatch or a gap costs ``COST``, and the best local score over the item's number of words is
the similarity.

A hit is a pair of neighbouring words of the item that stand in a text next to each other or with one word between. All
pairs of an item count, whatever their frequency. The number of hits that an alignment must have follows from its score: of
two matched neighbours that are no hit, either an item word is lost between them or two errors are paid. With m matches, h
hits and g lost words, m + g is at most the item's words L and the score at most 1 + h + g / 2, so a score of t * L needs
((t - 0.25) * L - 0.75) / 0.75 hits, whose diagonals differ by (1 - t) / ``COST`` * L at most. Only what has fewer hits is
not aligned: for thresholds of 0.5 and more no copy is lost, however its edits lie. At three words the two outer ones are
a pair too.

Items are handled in blocks of at most ``BLOCK_BYTES`` of text, so what goes to every task has that bound whatever the
size of the benchmark. Hits are handled in lots of about ``LOT``, never fewer than those of one text.

Defined cases: null or empty documents and items without words match nothing; an item of fewer than ``SEED`` words must be
found whole; repeated rows of either side give a row each; an empty table on either side gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIGNS, kept, mix, slices, words

SEED = 3
COST = 0.5
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
LOT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def align(item: np.ndarray, window: np.ndarray, cost: float = COST) -> float:
    """Best Smith-Waterman local score of two word sequences."""
    if not len(item) or not len(window):
        return 0.0
    steps = cost * np.arange(len(window) + 1)
    above, best = np.zeros(len(window) + 1), 0.0
    for word in item:
        row = np.maximum(above - cost, 0.0)
        np.maximum(row[1:], above[:-1] + np.where(window == word, 1.0, -cost), out=row[1:])
        # gaps along the window: the best earlier cell less its distance
        above = np.maximum.accumulate(row + steps) - steps
        best = max(best, float(above.max()))
    return best


def pairs(hashes: np.ndarray, rows: np.ndarray, gap: int, name: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word with the one that stands gap words on in its row. name: what kind of pair the hash is of."""
    n = max(len(hashes) - gap, 0)
    at = np.flatnonzero(rows[:n] == rows[gap:])
    return mix(hashes[at] * _P + hashes[at + gap] + np.uint64(name)), at


class Items:
    """Test items as word hashes, and their seeds: sorted hashes, each with item and place."""

    def __init__(self, ids: list, texts: list[str | None], seed: int = SEED):
        batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
        self.ids, self.words, seeds = ids, [], []
        for _, data, offsets in slices(batch):
            hashes, _, _, counts = words(data, offsets, between=SIGNS)
            ends = np.cumsum(counts)
            for k in range(len(counts)):
                own = hashes[ends[k] - counts[k] : ends[k]]
                # a pair of the item: gap in the item, gap in the text
                if len(own) < seed:
                    kinds = [(len(own) - 1, len(own) - 1)] if len(own) else []
                else:
                    kinds = [(1, 1), (1, 2)] + [(2, 1), (2, 2)] * (len(own) == 3)
                for gap, between in kinds:
                    grams, places = pairs(own, np.zeros(len(own), np.int64), gap, between)
                    seeds += [(g, len(self.words), place, between) for g, place in zip(grams.tolist(), places.tolist(), strict=True)]
                self.words.append(own)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.gaps = sorted({s[3] for s in seeds})
        self.seed, self.item, self.place = (np.array([s[k] for s in seeds], t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]

    def needed(self, threshold: float, seed: int = SEED) -> np.ndarray:
        """The number of hits that an alignment of each item has at least if it reaches the threshold."""
        least = np.ceil(((threshold - 0.25) * self.size - 0.75) / 0.75 - 1e-9).astype(np.int64)
        return np.where(self.size < seed, 1, np.maximum(least, 1))

    def hits(self, hashes: np.ndarray, counts: np.ndarray, most: int = LOT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, item and diagonal (place in the text less place in the item) of each hit, whole rows in lots."""
        rows, begins = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        ats, lows, numbers = [], [], []
        for gap in self.gaps:
            grams, at = pairs(hashes, rows, gap, gap)
            low = np.searchsorted(self.seed, grams)
            hit = np.flatnonzero(self.seed[np.minimum(low, len(self.seed) - 1)] == grams)
            ats.append(at[hit])
            lows.append(low[hit])
            numbers.append(np.searchsorted(self.seed, grams[hit], side="right") - low[hit])
        if not sum(map(len, ats)):
            return
        at, low, number = map(np.concatenate, (ats, lows, numbers))
        order = np.argsort(at, kind="stable")
        at, low, number = at[order], low[order], number[order]
        own = np.append(np.flatnonzero(np.append(True, np.diff(rows[at]) > 0)), len(at))  # where each row's hits begin
        total, k = np.append(0, np.cumsum(number)), 0
        while k < len(own) - 1:
            end = max(k + 1, int(np.searchsorted(total[own], total[own[k]] + most, side="right")) - 1)
            some = slice(own[k], own[end])
            n = number[some]
            of = np.repeat(low[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = np.repeat(at[some], n)
            row = rows[place]
            yield row, self.item[of], place - begins[row] - self.place[of]
            k = end


def passages(row: np.ndarray, item: np.ndarray, start: np.ndarray, need: np.ndarray, reach: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, item, first and last diagonal and hits of each run of hits that has as many as its item needs within its reach."""
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    near = reach[item]
    group = np.cumsum(np.append(False, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))
    code = group * (int(start.max()) - int(start.min()) + int(near.max()) + 1) + start
    end = np.searchsorted(code, code + near, side="right")
    full = np.flatnonzero(end - np.arange(len(code)) >= need[item])
    step = np.zeros(len(code) + 1, np.int64)
    step[full] += 1
    np.subtract.at(step, end[full], 1)
    left = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    if not len(left):
        return
    row, item, start, group, near = row[left], item[left], start[left], group[left], near[left]
    edges = np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (start[1:] - start[:-1] > near[1:]))), len(left))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(row[a]), int(item[a]), int(start[a]), int(start[b - 1]), b - a


def matches(docs: DataFrame, items: Items, schema: str, threshold: float, seed: int = SEED) -> DataFrame:
    """doc_id, item_id, similarity, seeds (hits) and word (where the passage may begin) of each document and item that reach the threshold."""
    need, reach = items.needed(threshold, seed), np.ceil((1 - threshold) / COST * items.size).astype(np.int64)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                hashes, _, _, counts = words(data, offsets, between=SIGNS)
                begins = np.cumsum(counts) - counts
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for lot in items.hits(hashes, counts):
                    for r, i, first, last, n in passages(*lot, need, reach):
                        own, text = items.words[i], hashes[begins[r] : begins[r] + counts[r]]
                        score = align(own, text[max(0, first - int(reach[i])) : last + len(own) + int(reach[i])]) / len(own)
                        if score >= threshold and score > best.get((r, i), (0.0,))[0]:
                            best[r, i] = (score, n, max(0, first))
                if best:
                    ids = part.column("doc_id").take(pa.array([r for r, _ in best]))
                    out = [ids, pa.array([items.ids[i] for _, i in best]), *(pa.array(x) for x in zip(*best.values(), strict=True))]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "item_id", "similarity", "seeds", "word"])

    return docs.select("doc_id", "text").mapInArrow(join, schema)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, seed: int = SEED) -> DataFrame:
    """doc_id, item_id, similarity, seeds and word of each document that holds a copy of an item, near or exact."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, seeds long, word long"
    rows = kept(benchmark.select("item_id", "text").filter(F.length("text") > 0).withColumn("bytes", F.octet_length("text").cast("long")), "items")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    blocks, out = -(-total * 2 // block_bytes), None
    for k in range(blocks):  # on average half a block each, dealt by a hash
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").select("item_id", "text").collect()
        items = Items([r["item_id"] for r in own], [r["text"] for r in own], seed)
        found = matches(docs, items, schema, threshold, seed)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item. A row is known by its doc_id and text, so that equal ids don't hide one another."""
    found = benchmark_matches(docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text"), benchmark, threshold).select("doc_id.*").distinct()
    left = found.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    return docs.join(left, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
