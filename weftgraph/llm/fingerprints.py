"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at each step it writes the character it stands on and goes on to the next one if a bit,
drawn from the step and the character, says so. Texts at a small edit distance soon fall into step again after an edit, so
their embeddings have a small Hamming distance. The fingerprint samples the embedding at fixed steps, ``SAMPLES`` from
each doubling of the number of steps, as one hex digit each, for ``WALKS`` walks: it grows with the logarithm of the text,
covers it to its end, and has the same steps for texts of any length. Each sample stands for as much text as its
doubling has steps per sample; likeness is the weighted share of equal samples, less what chance gives.

Banding hashes runs of samples into keys; documents that share a key are candidates, verified by likeness. Equal
fingerprints are one candidate, whatever number of texts has them. In a few turns each tries one other that a key of its
sets beside it, and those linked so far are one class; only pairs of a key that are still in different classes are then made. Marks of
both, the weight of their samples and a bit of each of the last ones, tell most pairs that can't be near before fingerprints
are compared. So a large group of near copies costs a pair for each, and no link of two that share a key is missed.

Walks go in step for all texts of a slice, a few numpy operations per step for all of them.

Defined cases: null counts as empty, with an empty fingerprint; two empty fingerprints have likeness 1, an empty and another
0; equal texts have equal fingerprints; rows of equal doc_id are ordered by text, null ids come last; the next of the last
row is the first, and of an only row itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, mix
from .components import components

WALKS = 2
SAMPLES = 32
BAND = 8
_PERIOD = 4096
_STOP = 255  # the class of the place after a text, where a walk stays
GROUP = 2048
#: Most steps that are walked with the whole group in hand before texts that have ended are put aside.
_CHECK = 64


def _steps(longest: int) -> np.ndarray:
    """The sampled steps, ascending: all of the first doublings, SAMPLES of each later one."""
    out, low = list(range(SAMPLES)), SAMPLES
    while low <= longest:
        picks = np.random.default_rng(low).choice(low, SAMPLES, replace=False) + low
        out += sorted(picks.tolist())
        low *= 2
    return np.array(out, np.int64)


def _weights(n: int) -> np.ndarray:
    """How many steps each sample stands for."""
    k = np.arange(n) // SAMPLES
    return np.where(k == 0, 1.0, 2.0 ** np.maximum(k - 1, 0))


_BITS = np.random.default_rng(97).integers(0, 2, (WALKS, _PERIOD, 256), dtype=np.uint8)
_BITS[:, :, _STOP] = 0


def embed(texts: list[np.ndarray]) -> list[str]:
    """The fingerprint of each text, given as its code points."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: list[str] = [""] * len(texts)
    group: list[int] = []
    room = 0
    for i in order:
        group.append(i)
        room += len(texts[i]) + 1
        if len(group) == GROUP or room > 4 << 20:
            _walk([texts[j] for j in group], group, out)
            group, room = [], 0
    if group:
        _walk([texts[j] for j in group], group, out)
    return out


def _walk(texts: list[np.ndarray], at: list[int], out: list[str]) -> None:
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    flat = np.full(int((lengths + 1).sum()), 0xFFFFFFFF, np.uint64)
    for t, b in zip(texts, begins.tolist(), strict=True):
        flat[b : b + len(t)] = t
    codes = (mix(flat) % np.uint64(255)).astype(np.uint8)
    digits = (mix(flat + np.uint64(1 << 40)) & np.uint64(15)).astype(np.uint8)
    codes[begins + lengths] = _STOP
    digits[begins + lengths] = 16
    stop = np.zeros(len(flat), bool)
    stop[begins + lengths] = True
    steps = _steps(16 * int(lengths.max(initial=0)) + 1024)
    parts = [[b""] * len(texts) for _ in range(WALKS)]
    for w in range(WALKS):
        place, alive, taken = begins.copy(), np.arange(len(texts)), []
        said: list[list[np.ndarray]] = [[] for _ in texts]
        step, k = 0, 0
        bits = _BITS[w]
        while len(alive):
            end = step + _CHECK
            while step < end:
                if k < len(steps) and steps[k] == step:
                    taken.append(digits[place])
                    k += 1
                place += bits[step & (_PERIOD - 1)][codes[place]]
                step += 1
            ended = stop[place]
            if ended.any() or k >= len(steps):
                if taken:
                    block = np.array(taken).T
                    for row, i in zip(block, alive.tolist(), strict=True):
                        said[i].append(row)
                    taken = []
                alive, place = alive[~ended], place[~ended]
        for i, rows in enumerate(said):
            row = np.concatenate(rows) if rows else np.zeros(0, np.uint8)
            parts[w][i] = row[row < 16].tobytes()
    hexes = bytes.maketrans(bytes(range(16)), b"0123456789abcdef")
    for i, place in enumerate(at):
        out[place] = ".".join(parts[w][i].translate(hexes).decode() for w in range(WALKS)) if lengths[i] else ""


def likeness(a: str, b: str) -> float:
    """Weighted share of equal samples of two fingerprints, less what chance gives; 0 to 1."""
    if not a or not b:
        return float(a == b)
    total = same = 0.0
    for x, y in zip(a.split("."), b.split("."), strict=True):
        p, q = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
        n = min(len(p), len(q))
        weights = _weights(max(len(p), len(q)))
        total += weights.sum()
        same += weights[:n][p[:n] == q[:n]].sum()
    return max(0.0, (same / total - 1 / 16) / (15 / 16)) if total else 1.0


def band_keys(fingerprint: str, band: int = BAND) -> list[int]:
    """Keys of all full runs of so many samples; texts that share one are candidates."""
    out = []
    for w, part in enumerate(fingerprint.split(".")):
        digits = np.frombuffer(part.encode(), np.uint8).astype(np.uint64)
        full = len(digits) // band
        if full:
            rows = digits[: full * band].reshape(full, band)
            key = np.full(full, w + 1, np.uint64)
            for c in range(band):
                key = mix(key * np.uint64(31) + rows[:, c])
            out += mix(key + np.arange(full, dtype=np.uint64)).view(np.int64).tolist()
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = embed([points(t or "") for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


#: Least likeness of near copies, and turns in which each fingerprint tries one other.
NEAR = 0.75
TURNS = 2


def _verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of prints (print, fingerprint) that are as alike as that."""
    side = lambda x: prints.select(F.col("print").alias(x), F.col("fingerprint").alias(f"_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([likeness(x, y) >= least for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


#: Of a fingerprint: the weight of all samples of each walk, the number of its last block of SAMPLES samples, and a bit of each sample of the last BLOCKS blocks, the walks side by side.
BLOCKS = 3
MARKS = ("w0", "w1", "j0", "j1", *(f"s{r}" for r in range(BLOCKS)))


def marks(fingerprint: str) -> tuple[int, ...]:
    weight, last, bits = [], [], [0] * BLOCKS
    for w, part in enumerate(fingerprint.split(".")):
        digits = np.frombuffer(part.encode(), np.uint8)
        weight.append(int(_weights(len(digits)).sum()))
        last.append(max(len(digits) - 1, 0) // SAMPLES)
        for j in range(max(0, last[-1] - BLOCKS + 1), last[-1] + 1):
            # 0 to 9 and a to f have their last bits spread alike
            odd = np.flatnonzero((digits[j * SAMPLES : (j + 1) * SAMPLES] ^ (digits[j * SAMPLES : (j + 1) * SAMPLES] >> 6)) & 1)
            bits[j % BLOCKS] |= sum(1 << int(k) for k in odd) << (SAMPLES * w)
    return (*weight, *last, *(x - (1 << 64) if x >> 63 else x for x in bits))


#: Rows of keys that a task of _meet gathers, and pairs that it looks at at once.
_MEET_ROWS, _MEET_PAIRS = 100_000, 1 << 20


def may_be_near(marks: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the marks (columns of MARKS) of rows a and b allow that likeness: neither samples that only one has nor those whose bits differ outweigh what may differ. No pair of that likeness is lost."""
    x, y = marks[a], marks[b]
    needed = least * 15 / 16 + 1 / 16 - 1e-9
    total = np.maximum(x[:, :2], y[:, :2]).sum(axis=1)
    good = np.minimum(x[:, :2], y[:, :2]).sum(axis=1) >= needed * total
    some = np.flatnonzero(good)
    x, y = x[some], y[some]
    differ = np.zeros(len(some))
    for r in range(BLOCKS):
        odd = (x[:, 4 + r] ^ y[:, 4 + r]).view(np.uint64)
        for w in range(WALKS):
            bits = np.bitwise_count((odd >> np.uint64(SAMPLES * w)) & np.uint64((1 << SAMPLES) - 1))
            block, other = (v[:, 2 + w] - (v[:, 2 + w] - r) % BLOCKS for v in (x, y))
            differ += np.where((block == other) & (block >= 0), 2.0 ** np.maximum(block - 1, 0) * bits, 0.0)
    good[some] = differ <= (1 - needed) * total[some]
    return good


def _meet(placed: DataFrame, least: float, turn: int | None) -> DataFrame:
    """Pairs of prints of different classes that share a key and may be near by their marks: in a turn (print, hub, key) of those that stand side by side by weight, otherwise all (a, b). Only pairs of like weights are made, so many at a time."""
    dealt = max(1, -(-placed.count() // _MEET_ROWS))

    def run(table: pa.Table) -> pa.Table:
        key, prints, group = (table[c].to_numpy() for c in ("key", "print", "class"))
        told = np.stack([table[m].to_numpy() for m in MARKS], axis=1)
        weight = told[:, 0] + told[:, 1]
        order = np.lexsort((prints, weight, key))
        key, prints, group, told, weight = key[order], prints[order], group[order], told[order], weight[order]
        n = len(key)
        if turn is not None:
            a = np.flatnonzero(key[1:] == key[:-1])
            a = a[group[a] != group[a + 1]]
            a = a[may_be_near(told, a, a + 1, least)]
            return pa.table({"print": np.concatenate([prints[a], prints[a + 1]]), "hub": np.concatenate([prints[a + 1], prints[a]]), "key": np.concatenate([key[a], key[a]])})
        # the rows of a key up to the heaviest that may be near: by doubling steps, as weights ascend within the key
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
        last = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        most = weight / (least * 15 / 16 + 1 / 16 - 1e-9)
        low, high = np.arange(n), last.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            fits = open_ & (weight[np.minimum(mid, n - 1)] <= most)
            low, high = np.where(fits, mid + 1, low), np.where(open_ & ~fits, mid, high)
        width = np.maximum(low - np.arange(n) - 1, 0)
        ends, found, at = np.cumsum(width), [], 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _MEET_PAIRS, side="right")))
            a = np.repeat(np.arange(at, stop), width[at:stop])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width[at:stop]) - width[at:stop], width[at:stop])
            new = group[a] != group[b]
            a, b = a[new], b[new]
            good = may_be_near(told, a, b, least)
            found.append(np.stack([np.minimum(prints[a[good]], prints[b[good]]), np.maximum(prints[a[good]], prints[b[good]])], axis=1))
            at = stop
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    kinds = "a long, b long" if turn is None else "print long, hub long, key long"
    return placed.groupBy(F.pmod(F.xxhash64("key"), F.lit(dealt)).alias("part")).applyInArrow(run, kinds)


def near_copies(docs: DataFrame, least: float = NEAR) -> DataFrame:
    """doc_id, fingerprint and class_id of each row: the smallest doc_id of those reached by links of likeness least or more between texts that share a band key; a text without characters is alone, as is one too short for a band unless it has an equal. A null doc_id names no class unless all of the class are null."""
    rows = kept(with_fingerprints(docs).withColumn("print", F.when(F.col("fingerprint") != "", F.xxhash64("fingerprint"))), "prints")
    prints = kept(rows.filter("print IS NOT NULL").groupBy("print").agg(F.first("fingerprint").alias("fingerprint")), "distinct")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_pylist()
            found = [sorted(set(band_keys(x))) for x in prints]
            row = np.repeat(np.arange(len(prints)), [len(x) for x in found])
            told = np.array([marks(x) for x in prints], np.int64).reshape(-1, len(MARKS))
            yield pa.record_batch([batch.column("print").take(pa.array(row)), pa.array([k for x in found for k in x], pa.int64()), *(pa.array(m) for m in told[row].T)], ["print", "key", *MARKS])

    placed = prints.mapInArrow(keys, "print long, key long, " + ", ".join(f"{m} long" for m in MARKS))
    shared = placed.groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low <> high").select("key")
    placed = kept(placed.join(shared, "key").withColumn("class", F.col("print")), "placed")
    found = groups = None
    for turn in range(TURNS):
        tried = _meet(placed, least, turn).groupBy("print").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("lot"), F.col("hub").alias("hub"))).alias("t"))
        pairs = kept(tried.select(F.least("print", "t.hub").alias("a"), F.greatest("print", "t.hub").alias("b")).distinct(), "tried")
        links = _verified(pairs, prints, least)
        found = kept(links if found is None else found.unionByName(links).distinct(), "links")
        groups = components(found)
        named = placed.drop("class").join(groups.withColumnsRenamed({"node": "print", "component": "class"}), "print", "left").withColumn("class", F.coalesce("class", "print"))
        several = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
        placed = kept(named.join(several, "key"), "placed")
    pairs = _meet(placed, least, None).distinct()
    groups = components(kept(found.unionByName(_verified(kept(pairs, "pairs"), prints, least)), "links"))
    named = rows.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("class", F.coalesce("component", "print"))
    names = named.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return named.join(names, "class", "left").select("doc_id", "fingerprint", F.coalesce("class_id", "doc_id").alias("class_id"))


def edited_text(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many characters of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of docs in runs: bucket, and in it doc_id descending. The last row of each bucket, marked by tail, is the first of the next one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted(set((rows.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else [])), reverse=True)
    # bucket 0 has the largest ids; null ids come after all
    bucket = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(int(b)) for b in bounds])
        bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(edges, lambda e: F.col("doc_id") < e)))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("tail", F.lit(False))
    key = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), F.xxhash64("text").alias("text"))
    firsts = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min(key).alias("first")).collect()}
    filled = sorted(firsts)
    if not filled:
        return rows
    # the first row of each bucket also ends the bucket before, and that of the first one the last
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    leads = docs.sparkSession.createDataFrame([(b, None if firsts[b]["none"] else -firsts[b]["down"], firsts[b]["text"], before[b]) for b in filled], "b int, id long, h long, to int")
    match = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h"))
    tails = rows.join(F.broadcast(leads), match).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("tail"))
    return rows.unionByName(tails)


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = neighbours(docs, parts).repartition(max(1, parts // 4), "bucket").sortWithinPartitions(*order).select("bucket", "tail", "doc_id", "text")

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        """A record for each text but the last, which follows the one before it."""
        edited = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        prints = embed([points(t) for t in texts + edited])
        own, changed = prints[: len(texts)], prints[len(texts) :]
        columns = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], own[:-1], changed, [likeness(a, b) for a, b in zip(own, changed, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        bucket, size, done = None, 0, False
        for batch in batches:
            for b, tail, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, ids, texts, size, done = b, [], [], 0, False
                if done:
                    continue  # a tail that repeats
                ids.append(i)
                texts.append(text)
                size += len(text)
                done = tail
                if done or len(texts) > GROUP or size > 8 << 20:
                    if len(texts) > 1:
                        yield made(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return kept(rows.mapInArrow(run, kinds), "prints")
