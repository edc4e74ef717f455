"""What the operators of this subpackage share: tables cut out of the lineage, and hashing of whole Arrow text columns.

Texts are hashed as bytes, in slices of some rows, so that the work is a few numpy passes over each slice whatever the
number of words. A slice never splits a row; memory is bounded by ``SLICE_BYTES`` or by the longest single text.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
#: Bytes between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same, and all ASCII bytes that are neither letters nor digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session without one gets one on this machine, if it runs here alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read back: computed once, with no lineage that a lost executor would replay."""
    path = f"{shared_folder(df.sparkSession)}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learnt(rows: DataFrame, fit: Callable[[Iterator[dict]], object]) -> object:
    """What fit makes of the rows, a sample of bounded size, in their order. It works in one task: the driver holds neither the rows nor what fit needs meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
        found = fit(each)
        for _ in each:  # the rows that fit leaves are read too, as the worker is used again
            pass
        yield pa.record_batch([pa.array([pickle.dumps(found)], pa.binary())], ["found"])

    found = rows.coalesce(1).mapInArrow(run, "found binary").first()
    return pickle.loads(found[0]) if found else fit(iter(()))


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch of about ``most`` bytes of text, with their bytes and offsets. text: a column, or a field of one after a dot."""
    column, _, field = text.partition(".")
    data, offsets = utf8(pc.struct_field(batch.column(column), field) if field else batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each row."""
    inside = ~between[data]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[filled] = inside[filled]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(last) + 1, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same for equal spans wherever they stand."""
    bits = max(SLICE_BYTES.bit_length(), int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, bits)[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_P_INVERSE, bits)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, A to Z in lower case if asked; and the number of words of each row."""
    starts, ends, counts = word_bounds(data, offsets, between)
    return span_hashes(LOWER[data] if lower else data, starts, ends), starts, ends, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words that stays within a row, and its row. short: a row of fewer words has all of them as one run."""
    rows = np.repeat(np.arange(len(counts)), counts)
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= n:
        runs = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            runs = runs * np.uint64(_P) + hashes[k : len(hashes) - n + 1 + k]
        whole = rows[: len(runs)] == rows[n - 1 :]
        out, at = mix(runs[whole] + np.uint64(n)), rows[: len(runs)][whole]
    if short and ((counts > 0) & (counts < n)).any():
        begins = np.cumsum(counts) - counts
        for k in range(1, n):
            if len(some := np.flatnonzero(counts == k)):
                run = np.zeros(len(some), np.uint64)
                for j in range(k):
                    run = run * np.uint64(_P) + hashes[begins[some] + j]
                out, at = np.append(out, mix(run + np.uint64(k))), np.append(at, some)
    return out, at


def by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, where each row has so many in turn."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]
