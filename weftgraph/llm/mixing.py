"""Mixing sources to target weights by the cube method.

Each source has a target in words. Its documents share one rate, target / size of the source: the whole part of the rate is
taken of every document, and the fraction is an inclusion probability. The flight phase moves those probabilities along the
null space of two balancing constraints (words taken, documents taken) until nearly all are 0 or 1. It runs in blocks of a
source that a hash of doc_id deals out, so a source that holds a third of all rows is many small tasks; what each block
leaves open, at most two documents, flies again per source. The landing problem that remains holds those and a small
reserve of short documents, whose probabilities are shifted to absorb the error that rounding the last ones makes.

A row is dealt to a block by its doc_id and text. Where one pair of both has more rows than a block, these equal rows are
dealt by their places in the table, so that no block grows with them.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last; a
null doc_id is an id like others; repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored. doc_id is passed on as it is, whatever its type.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import kept, slices, word_bounds

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK_ROWS = 20_000
RESERVE = 64
RESERVE_BLOCKS = 8


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), draw (a hash of doc_id and text) and row (a number of its own)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = [word_bounds(data, offsets)[2] for _, data, offsets in slices(batch)]
            columns = [batch.column("doc_id"), batch.column("source"), pa.array(np.concatenate(sizes or [np.zeros(0)]).astype(np.int64)), batch.column("draw"), pa.array(np.arange(row, row + batch.num_rows))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "size", "draw", "row"])

    columns = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", F.xxhash64("doc_id", "text", F.lit("mix")).alias("draw"))
    kinds = StructType([*columns.select("doc_id", "source").schema, StructField("size", LongType()), StructField("draw", LongType()), StructField("row", LongType())])
    return columns.mapInArrow(count, kinds)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with a column rank, 0 and up in that order. Partitions of a range sort are numbered one by one, never in a single task."""
    at = kept(df.withColumn("_null", F.col("source").isNull()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = {r["_part"]: r["n"] for r in at.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(before):
        starts[part], total = total, total + before[part]
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    return at.withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + first[F.col("_part")]).drop("_part", "_null")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size and target: the total shared by weight, no target above cap times its source's size, the excess reshared."""
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = kept(sources.withColumn("weight", weight), "sources")
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > F.col("source_size") * cap
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size") * cap).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        level, capped = (r["all"] - r["held"]) / r["open"], r["n"]
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level or 0)), F.col("source_size") * cap).alias("target"))


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping sum(p) and sum(p * sizes); at most two stay between."""
    p = p.astype(float).copy()
    draws = rng.random(2 * len(p) + 2)
    active: list[int] = []
    step = 0
    for k in range(len(p)):
        if 1e-9 < p[k] < 1 - 1e-9:
            active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        way = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]
        if way[0] == way[1] == way[2] == 0:
            way = [1.0, -1.0, 0.0]
        up, down = 1e300, 1e300
        for i, w in zip(active, way, strict=True):
            if w > 0:
                up, down = min(up, (1 - p[i]) / w), min(down, p[i] / w)
            elif w < 0:
                up, down = min(up, p[i] / -w), min(down, (1 - p[i]) / -w)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for i, w in zip(active, way, strict=True):
            p[i] += move * w
            if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                p[i] = round(p[i])
        active = [i for i in active if 0 < p[i] < 1]
    return p


def nearest(p: np.ndarray, sizes: np.ndarray, goal: float) -> np.ndarray:
    """The last few fractions set to 0 or 1 so that the words taken come nearest to the goal."""
    open_, out = np.flatnonzero((p > 0) & (p < 1)), p.copy()
    best = None
    for bits in range(1 << len(open_)):
        out[open_] = [(bits >> i) & 1 for i in range(len(open_))]
        if best is None or abs(out @ sizes - goal) < best[0]:
            best = (abs(out @ sizes - goal), out.copy())
    return best[1] if best else out


def _seed(*key: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(key).encode()))


def _rows(rows: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """The rows of a group, largest first, and their numbers."""
    rows = rows.sort_by([("size", "descending"), ("draw", "ascending"), ("row", "ascending")])
    return rows, {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("size", "draw", "p", "block", "held")}


def _with(rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    for name, values in columns.items():
        rows = rows.set_column(rows.column_names.index(name), name, pa.array(values))
    return rows


def _block(group: pa.Table) -> pa.Table:
    rows, at = _rows(group)
    sizes, p, block = at["size"].astype(float), at["p"].astype(float), int(at["block"][0])
    held = np.zeros(len(p), bool)
    if block < RESERVE_BLOCKS:
        short = np.flatnonzero((sizes > 0) & (sizes <= np.quantile(sizes, 0.8)))
        held[short[np.argsort(at["draw"][short], kind="stable")[:RESERVE]]] = True
    p[~held] = flight(p[~held], sizes[~held], _seed(rows.column("source")[0].as_py(), block))
    return _with(rows, p=p, held=held)


def _landing(group: pa.Table) -> pa.Table:
    rows, at = _rows(group)
    sizes, rate, held = at["size"].astype(float), at["p"].astype(float), at["held"].astype(bool)
    rng, goal = _seed(rows.column("source")[0].as_py(), "landing"), float(rate @ sizes)
    p = rate.copy()
    p[~held] = flight(rate[~held], sizes[~held], rng)
    left = np.flatnonzero((p > 0) & (p < 1) & ~held)
    p[left] = np.round(p[left])
    if held.any():
        error, room = goal - p @ sizes, sizes[held].sum()
        p[held] = flight(np.clip(p[held] + error / room, 0, 1), sizes[held], rng)
    return _with(rows, p=nearest(p, sizes, goal))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes of the document, repeats counted) of each document."""
    sizes = kept(sized(docs), "sizes")
    goals = targets(sizes, weights, cap)
    largest = sizes.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = -(-largest // block_rows) or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("doc_id", "d.source", "size", "draw", "row", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
        .withColumn("block", F.pmod("draw", F.lit(blocks)).cast("long"))
        .withColumn("held", F.lit(False))
    )
    fullest = rows.groupBy("source", "block").count().agg(F.max("count")).first()[0] or 0
    if fullest > 4 * block_rows:  # rows that are all alike: dealt by their places
        hot = rows.groupBy("source", "draw").count().filter(F.col("count") > block_rows).select(F.col("source").alias("_source"), F.col("draw").alias("_draw"))
        marked = rows.join(hot, F.col("source").eqNullSafe(F.col("_source")) & (F.col("draw") == F.col("_draw")), "left")
        rows = marked.withColumn("block", F.when(F.col("_draw").isNotNull(), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")).otherwise(F.col("block"))).drop("_source", "_draw")
    flown = kept(rows.groupBy("source", "block").applyInArrow(_block, rows.schema), "flown")
    open_ = F.col("held") | ((F.col("p") > 0) & (F.col("p") < 1))
    landed = flown.filter(open_).groupBy("source").applyInArrow(_landing, rows.schema)
    return flown.filter(~open_).unionByName(landed).select("doc_id", "source", "size", "source_size", "target", ((F.col("whole") + F.col("p").cast("long")) * F.col("size")).alias("taken"))
