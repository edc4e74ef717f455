"""Pairs of near texts of a document, by their sets of words. Words count as 64-bit hashes, equal sets as one.

Two near sets share a word of the first part of both, in one order of all words that has rare ones first. Sets are dealt into
blocks, and each pair of blocks of a document is a task that joins these parts: sizes, places of the shared word and marks
(parities of hashed words) tell most pairs that can't be near, before any leaves the task. The few that are left meet their
whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..tables import stored

#: Words whose number of sets goes to every task: the commonest. All others count as rare.
COMMON = 500_000
#: Most sets of a block (smaller documents are dealt into up to eight of some thousand), pairs that a task looks at at once, and longs of parity bits of a set.
BLOCK, PAIRS, LONGS = 1 << 15, 1 << 20, 32
_HASHES: dict[bytes, int] = {}


def _hashed(found: set[bytes]) -> np.ndarray:
    if len(_HASHES) > 1 << 20:
        _HASHES.clear()
    for w in [w for w in found if w not in _HASHES]:
        _HASHES[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)
    out = np.fromiter((_HASHES[w] for w in found), np.int64, len(found))
    out.sort()
    return out


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate(values), kind))


def word_sets(chunks: DataFrame) -> DataFrame:
    """doc, pos, set (a key of its words), n and words of each chunk (doc, pos, text) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(row, _hashed(set(found))) for row, found in enumerate(W.words(batch.column("text").to_pylist(), "plain")) if found]
            for at in range(0, len(held), 1024):
                rows, sets = zip(*held[at : at + 1024], strict=True)
                keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                some = batch.take(pa.array(rows))
                yield pa.record_batch([some.column("doc"), some.column("pos"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets, pa.int64())], ["doc", "pos", "set", "n", "words"])

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("doc", "pos"))
    return chunks.select("doc", "pos", "text").filter("doc IS NOT NULL AND pos IS NOT NULL").mapInArrow(run, f"{kinds}, set long, n long, words array<long>")


def _signed(sets: DataFrame, least: float) -> DataFrame:
    """doc, set, n, first (the words of the first part, in their order, as 32 bits) and mark of each set."""
    counted = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter("df > 1")
    table = counted.orderBy(F.desc("df")).limit(COMMON).toArrow().sort_by("word")
    shared = sets.sparkSession.sparkContext.broadcast((table["word"].to_numpy(), table["df"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, df = shared.value
        for batch in batches:
            lists = batch.column("words")
            size = pc.list_value_length(lists).to_numpy().astype(np.int64)
            values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            often = np.zeros(len(values), np.int64)
            if len(common):
                near = np.minimum(np.searchsorted(common, values), len(common) - 1)
                often = np.where(common[near] == values, df[near], 0)
            order = np.lexsort((values, often, row))
            at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            most = (size - np.ceil(size * least - 1e-9) + 1).astype(np.int64)
            first = values[order][at < most[row]].astype(np.int32)
            bit = row * (64 * LONGS) + ((values >> 20) % (64 * LONGS))
            odd = np.bincount(bit, minlength=len(size) * 64 * LONGS) & 1
            mark = np.packbits(odd.astype(bool).reshape(len(size), 64 * LONGS), axis=1)
            starts = pa.array(np.concatenate([[0], np.cumsum(np.minimum(most, size))]), pa.int32())
            yield pa.record_batch([batch.column("doc"), batch.column("set"), pa.array(size), pa.ListArray.from_arrays(starts, pa.array(first)), pa.array([m.tobytes() for m in mark], pa.binary())], ["doc", "set", "n", "first", "mark"])

    return sets.select("doc", "set", "words").mapInArrow(run, f"doc {sets.schema['doc'].dataType.simpleString()}, set long, n long, first array<int>, mark binary")


def cell_pairs(left: tuple, right: tuple, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks (n, words of first parts, their row and place, marks) that may be near; same: of one block, each pair once."""
    (na, wa, ra, pa_, ma), (nb, wb, rb, pb, mb) = left, right
    order = np.argsort(wb, kind="stable")
    wb, rb, pb = wb[order], rb[order], pb[order]
    xa, xb = na[ra], nb[rb]
    la, lb = xa - pa_, xb - pb
    low, high = np.searchsorted(wb, wa), np.searchsorted(wb, wa, side="right")
    width = high - low
    ends, found, at = np.cumsum(width), [np.zeros(0, np.int64)], 0
    share = least / (1 + least)
    while at < len(wa):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        some = width[at:stop]
        i = np.repeat(np.arange(at, stop), some)
        j = np.repeat(low[at:stop] - (np.cumsum(some) - some), some) + np.arange(len(i))
        at = stop
        # sizes sift first, then what is left of both from the shared word on
        x, y = xa[i], xb[j]
        good = np.flatnonzero(np.minimum(x, y) >= least * np.maximum(x, y) - 1e-6)
        i, j, both = i[good], j[good], (x + y)[good]
        good = np.minimum(la[i], lb[j]) >= share * both - 1e-6
        a, b = ra[i[good]], rb[j[good]]
        if same:
            a, b = a[a < b], b[a < b]
        pairs = np.unique(a * len(nb) + b)
        for k in range(0, len(pairs), 1 << 15):
            a, b = pairs[k : k + (1 << 15)] // len(nb), pairs[k : k + (1 << 15)] % len(nb)
            differ = np.bitwise_count(ma[a] ^ mb[b]).sum(axis=1, dtype=np.int64)
            found.append(pairs[k : k + (1 << 15)][differ <= (1 - 2 * share) * (na[a] + nb[b]) + 1e-6])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(len(nb), 1), pairs % max(len(nb), 1)


def near_sets(sets: DataFrame, least: float) -> DataFrame:
    """doc, a, b of pairs of different sets that may be near."""
    signed = stored(_signed(sets, least))
    blocks = stored(signed.groupBy("doc").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.ceil(F.count("*") / 4096), F.lit(8))).cast("int").alias("blocks")))
    own = signed.join(blocks, "doc").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other")

    def run(table: pa.Table) -> pa.Table:
        def side(rows: pa.Table) -> tuple:
            rows = rows.combine_chunks()
            lists = rows["first"].combine_chunks() if isinstance(rows["first"], pa.ChunkedArray) else rows["first"]
            size = pc.list_value_length(lists).to_numpy().astype(np.int64)
            marks = np.frombuffer(b"".join(rows["mark"].to_pylist()), np.uint64).reshape(-1, LONGS)
            return rows["n"].to_numpy(), lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size), marks

        lo, hi, block = table["lo"][0].as_py(), table["hi"][0].as_py(), table["block"]
        left = table.filter(pc.equal(block, lo))
        right = left if lo == hi else table.filter(pc.equal(block, hi))
        if not len(left) or not len(right):
            return pa.table({"doc": table["doc"].slice(0, 0), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        one = side(left)
        a, b = cell_pairs(one, one if lo == hi else side(right), least, lo == hi)
        return pa.table({"doc": left["doc"].take(pa.array(a)), "a": left["set"].take(pa.array(a)), "b": right["set"].take(pa.array(b))})

    kind = sets.schema["doc"].dataType.simpleString()
    return dealt.groupBy("doc", "lo", "hi").applyInArrow(run, f"doc {kind}, a long, b long")


def near_pairs(chunks: DataFrame, least: float) -> DataFrame:
    """doc, a < b and similarity of chunks (doc, pos, text) of a document whose word sets are this near."""
    rows = stored(word_sets(chunks))
    members = rows.select("doc", "set", "pos")
    sets = stored(rows.dropDuplicates(["doc", "set"]).select("doc", "set", "n", "words"))
    pairs = stored(near_sets(sets, least))
    side = lambda x: sets.select("doc", F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("words").alias(f"w{x}"))
    shared = F.size(F.array_intersect("wa", "wb"))
    whole = pairs.join(side("a"), ["doc", "a"]).join(side("b"), ["doc", "b"]).withColumn("similarity", shared / (F.col("na") + F.col("nb") - shared))
    several = members.groupBy("doc", "set").agg(F.count("*").alias("k")).filter("k > 1").select("doc", F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity"))
    near = stored(whole.filter(F.col("similarity") >= least).select("doc", "a", "b", "similarity").unionByName(several))
    end = lambda x: members.select("doc", F.col("set").alias(x), F.col("pos").alias(f"p{x}"))
    met = near.join(end("a"), ["doc", "a"]).join(end("b"), ["doc", "b"]).filter("pa < pb OR (a <> b AND pa > pb)")
    return met.select("doc", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "similarity")
