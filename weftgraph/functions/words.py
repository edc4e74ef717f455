"""The token rules of ``text`` over whole Arrow columns: a few numpy passes over the characters of a slice, whatever the number of words."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..constants import KEYWORD_STOPWORDS, STOPWORDS

#: Characters that are looked at at once; a text is never split.
SLICE = 1 << 20
_LOWER, _WORD, _BODY = (np.zeros(256, bool) for _ in range(3))
_LOWER[97:123] = True
_WORD[[95, *range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BODY[[45, 95, *range(48, 58), *range(97, 123)]] = True
_BLANK = 32


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each code point is read as: ASCII in lower case, X for other letters and numbers, blank for the rest."""
    out = np.array([88 if unicodedata.category(chr(c))[0] in "LN" else _BLANK for c in range(0x110000)], np.uint8)
    out[:128] = np.arange(128)
    out[65:91] += 32
    out[[0x212A, 0x130]] = ord("k"), ord("i")  # the letters outside ASCII whose lower case is in it
    return out


def _bounds(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def token_spans(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Start and end of each match of \\b[a-z][a-z0-9_-]+\\b; m begins and ends with a blank. A run of such characters has one match at most: from its first letter at a boundary to its last boundary."""
    begins, ends = _bounds(_BODY[m])
    word = _WORD[m]
    at_bound = np.flatnonzero(word[1:] != word[:-1]) + 1
    heads = np.flatnonzero(_LOWER[m[1:]] & ~word[:-1]) + 1
    if not len(heads) or not len(begins):
        return begins[:0], begins[:0]
    which = np.searchsorted(heads, begins)
    start = heads[np.minimum(which, len(heads) - 1)]
    good = (which < len(heads)) & (start < ends)
    end = at_bound[np.searchsorted(at_bound, ends, side="right") - 1]
    good &= end >= start + 2
    return start[good], end[good]


def plain_spans(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""Start and end of each match of \\b[a-z]{3,}\\b."""
    begins, ends = _bounds(_LOWER[m])
    good = (ends >= begins + 3) & ~_WORD[m[begins - 1]] & ~_WORD[m[ends]] if len(begins) else np.zeros(0, bool)
    return begins[good], ends[good]


_RULES = {
    "tokens": (token_spans, frozenset(w.encode() for w in STOPWORDS)),
    "long": (token_spans, frozenset(w.encode() for w in KEYWORD_STOPWORDS)),
    "plain": (plain_spans, frozenset()),
}


def words(texts: list[str | None], rule: str) -> Iterator[list[bytes]]:
    """The words of each text in turn by a rule: tokens, long (tokens of three or more characters, the longer list of stop words) or plain."""
    spans, stop = _RULES[rule]
    at = 0
    while at < len(texts):
        some, room = [], 0
        while at < len(texts) and (not some or room + len(texts[at] or "") < SLICE):
            some.append(texts[at] or "")
            room += len(some[-1]) + 1
            at += 1
        codes = np.frombuffer(("\n" + "\n".join(some) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        m = _classes()[codes]
        start, end = spans(m)
        if rule == "long":
            start, end = start[end - start > 2], end[end - start > 2]
        # words are laid out anew with a blank after each
        size = end - start
        out = np.full(int(size.sum()) + len(size), _BLANK, np.uint8)
        held = np.ones(len(out), bool)
        held[np.cumsum(size + 1) - 1] = False
        out[held] = m[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        lengths = np.fromiter((len(t) + 1 for t in some), np.int64, len(some))
        cut = np.concatenate([[0], np.searchsorted(start, np.cumsum(lengths))])
        offset = np.concatenate([[0], np.cumsum(size + 1)])[cut]
        data = out.tobytes()
        for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
            found = data[a:b].split()
            yield [w for w in found if w not in stop] if stop else found


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


#: Words that a task counts before it hands them on.
COUNTED = 1 << 18


def counts_by_ids(rows: DataFrame, rule: str) -> DataFrame:
    """ids, token, n and first (pos and at of its first occurrence) of the words of texts that have the same ids, counted where they are read. rows: ids (array<string>), pos (long) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, dict]] = {}
        room = 0

        def out() -> pa.RecordBatch:
            told = [(ids, token, n, *first[token]) for ids, (counts, first) in held.items() for token, n in counts.items()]
            ids, tokens, n, pos, at = map(list, zip(*told, strict=True))
            first = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(at, pa.int32())], ["pos", "at"])
            return pa.record_batch([pa.array(ids, pa.list_(pa.string())), strings(tokens), pa.array(n, pa.int64()), first], ["ids", "token", "n", "first"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for ids, pos, found in zip(batch.column("ids").to_pylist(), batch.column("pos").to_pylist(), words(texts, rule), strict=True):
                if not ids or not found:
                    continue
                counts, first = held.setdefault(tuple(ids), (Counter(), {}))
                room -= len(counts)
                counts.update(found)
                room += len(counts)
                for at in range(len(found) - 1, -1, -1):
                    if (before := first.get(found[at])) is None or (pos, at) < before:
                        first[found[at]] = (pos, at)
                if room >= COUNTED:
                    yield out()
                    held.clear()
                    room = 0
        if held:
            yield out()

    return rows.select("ids", "pos", "text").mapInArrow(run, "ids array<string>, token string, n long, first struct<pos: long, at: int>")
