"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the distinct training tokens (words and the end of a text) and one symbol for any other word. A state is the
whole words before a token, up to ``DEPTH - 1`` of them; the empty one is the root. With n the count of a symbol after a
context, N that of the context and P its suffix's distribution, a context tells a symbol with

    (max(n - 1, 0) + (T + PRIOR) * P) / (N + PRIOR),  T = N - sum of max(n - 1, 0),

so a symbol that followed once counts as one that never did, and all symbols sum to one. A context stays in the tree if
its distribution diverges from its suffix's by at least ``GAIN`` nats over all its occurrences, a fixed test whatever the
corpus; so the tree, like the vocabulary, grows with the input. The root tells a training token by its discounted share and any
other word by what the discount frees. A token is scored by the longest retained context before it.

Texts are cut into blocks of whole documents of about ``BLOCK_BYTES``, each a file of word hashes and places in the shared
folder. A block sends its distinct n-grams once, as sorted hashes, to the task of their bucket (``BUCKET_TOKENS`` tokens
each), which answers with their counts where those matter; then the pairs that it owns and the contexts that it holds,
and is told which of them stay. What a task holds is bounded by a block, a bucket or the longest text, and a frequent word
is one entry of a block. Nothing is broadcast, and only four sums come to the driver.

Defined cases: a null or empty text is its end token alone; a null doc_id counts as remainder 0, held out; repeated rows
are scored and counted each; a token of any length is one word; an empty table gives an empty result; with no training
documents the unknown word is certain, all scores are 0; other columns are ignored. Words are told apart by 64 bits of a
hash, longer n-grams by 48.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row, kept, mix, shared_folder, slices, store, words

#: The longest n-gram counted: contexts are of up to DEPTH - 1 words.
DEPTH = 3
#: Nats by which a context diverges from its suffix, at least, if it stays.
GAIN = 2.0
PRIOR = 5.0
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 200_000
BUCKET_TOKENS = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xE4D0F7E875C0FFEE)
_Q = 2000.0  # steps of a nat that probabilities are sent with


def held_out(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0)) == 0


def pack(values: np.ndarray) -> bytes:
    """Numbers of 0 and more, by planes of their bytes."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(values).to_bytes(6, "little") + width.to_bytes(1, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:6], "little"), data[6]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[7:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n).astype(np.uint64)


def steps(ascending: np.ndarray) -> bytes:
    return pack(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# --- blocks ---------------------------------------------------------------------------------------------------------


def write_blocks(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows (doc_id, text, held_out) as blocks and returns block, path and tokens of each. A task that is run again writes files of its own; only those that the table names count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = store(folder)
        where.create_dir(path, recursive=True)
        at, held = TaskContext.get().partitionId() << 32, []

        def out() -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h, _ in held])
            vocabulary, ids = np.unique(hashes, return_inverse=True)
            part = pa.concat_batches([b for b, _, _ in held])
            whole = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c)) for c in ("doc_id", "held_out")]
            whole += [pa.array([x], pa.binary()) for x in (pack(np.concatenate([c for _, _, c in held])), steps(vocabulary), pack(ids))]
            name = f"{folder}/{uuid.uuid4().hex}.block"
            batch = pa.record_batch(whole, ["doc_id", "held_out", "counts", "vocabulary", "ids"])
            with where.open_output_stream(f"{path}/{name.rsplit('/', 1)[1]}") as file, pa.ipc.new_stream(file, batch.schema) as stream:
                stream.write_batch(batch)
            return pa.record_batch([pa.array([at]), pa.array([name]), pa.array([len(ids)])], ["block", "path", "tokens"])

        size = n = 0
        for batch in batches:
            for part, data, offsets in slices(batch):
                if held and (size + len(data) > BLOCK_BYTES or n + part.num_rows > BLOCK_ROWS):
                    yield out()
                    at, held, size, n = at + 1, [], 0, 0
                hashes, _, _, counts = words(data, offsets)
                symbols = np.full(len(hashes) + len(counts), _END)
                symbols[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes
                held.append((part.select(["doc_id", "held_out"]), symbols, counts + 1))
                size, n = size + len(data), n + part.num_rows
        if held:
            yield out()

    return kept(rows.mapInArrow(write, "block long, path string, tokens long"), "blocks")


class Block:
    """The tokens of some documents, and their distinct n-grams by length, in the order of their hashes."""

    def __init__(self, path: str, depth: int):
        where, name = store(path)
        with where.open_input_file(name) as file:
            self.row = pa.ipc.open_stream(file).read_next_batch()
        counts, vocabulary, ids = (self.row.column(c)[0].as_py() for c in ("counts", "vocabulary", "ids"))
        self.counts, vocabulary, ids = unpack(counts).astype(np.int64), unsteps(vocabulary), unpack(ids).astype(np.int32)
        ends = np.cumsum(self.counts)
        self.place = np.arange(len(ids), dtype=np.int32) - np.repeat((ends - self.counts).astype(np.int32), self.counts)
        self.learnt = np.repeat(~self.row.column("held_out")[0].values.to_numpy(zero_copy_only=False).astype(bool), self.counts)
        #: for each length: hashes, the rank of the n-gram that ends at each token (-1: none), and a token where each ends
        self.keys, self.rank, self.first = {1: vocabulary}, {1: ids}, {1: np.zeros(len(vocabulary), np.int32)}
        self.first[1][ids] = np.arange(len(ids), dtype=np.int32)
        for n in range(2, depth + 1):
            self._longer(n)

    def _longer(self, n: int) -> None:
        shorter, ids = self.rank[n - 1], self.rank[1]
        at = np.flatnonzero(self.place >= n - 1)
        code = shorter[at - 1].astype(np.int64) * len(self.keys[1]) + ids[at]
        bits = int(len(ids)).bit_length()
        if len(at) and int(code.max()).bit_length() + bits < 64:
            packed = np.sort(code << bits | at)
            code, at = packed >> bits, packed & ((1 << bits) - 1)
        else:
            order = np.argsort(code, kind="stable")
            code, at = code[order], at[order]
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        first = at[new]
        hashes = mix(self.keys[n - 1][shorter[first - 1]] * _P + self.keys[1][ids[first]] + np.uint64(n)) >> np.uint64(16)
        order = np.argsort(hashes)
        own = np.empty(len(order), np.int32)
        own[order] = np.arange(len(order), dtype=np.int32)
        self.keys[n], self.first[n], self.rank[n] = hashes[order], first[order].astype(np.int32), np.full(len(ids), -1, np.int32)
        self.rank[n][at] = own[np.cumsum(new) - 1]

    def train_counts(self, n: int) -> np.ndarray:
        return np.bincount(self.rank[n][self.learnt & (self.place >= n - 1)], minlength=len(self.keys[n]))

    def contexts(self, n: int, counts: np.ndarray) -> np.ndarray:
        """Ranks of the n-grams that something follows and that training saw twice or more."""
        used = np.zeros(len(self.keys[n]), bool)
        used[self.rank[n][np.flatnonzero(self.place >= n) - 1]] = True
        return np.flatnonzero(used & (counts >= 2))


def bucket_bounds(keys: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending hashes, and the end."""
    high = keys >> np.uint64(32 if n == 1 else 16)
    return np.searchsorted((high * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


# --- the two exchanges ----------------------------------------------------------------------------------------------

SENT = "bucket int, block long, length int, start long, keys binary, counts binary, pairs binary, whole binary, shares binary"
TOLD = "block long, length int, start long, at binary, n binary, sums array<long>"


def _sent(bucket: int, block: int, length: int, start: int, *blobs: bytes | None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    blobs = (*blobs, *[None] * (5 - len(blobs)))
    return pa.record_batch([pa.array([v], k) for v, k in zip((bucket, block, length, start, *blobs), kinds, strict=True)], ["bucket", "block", "length", "start", "keys", "counts", "pairs", "whole", "shares"])


def _told(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "length", "start", "at", "n", "sums"])


def send_ngrams(depth: int, buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist(), strict=True):
                block = Block(path, depth)
                for n in range(1, depth + 1):
                    counts, bounds = block.train_counts(n), bucket_bounds(block.keys[n], n, buckets)
                    for b in np.flatnonzero(np.diff(bounds)).tolist():
                        own = slice(bounds[b], bounds[b + 1])
                        yield _sent(b, at, n, int(bounds[b]), steps(block.keys[n][own]), pack(counts[own]))

    return send


def _joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of some rows, the place of each row's hashes among them, and where each row's begin."""
    keys = [unsteps(r["keys"]) for r in rows]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, inverse, np.cumsum([0, *map(len, keys)])


def tell_counts(sent: pa.Table) -> pa.Table:
    """The counts of a bucket's n-grams, to each block that holds them: words that training has, longer ones that it has twice. Twice the count, and one more for the block that owns it."""
    out, rows = [], sent.to_pylist()
    for n in sorted({r["length"] for r in rows}):
        some = sorted((r for r in rows if r["length"] == n), key=lambda r: r["block"])
        unique, inverse, begins = _joined(some)
        total = np.bincount(inverse, np.concatenate([unpack(r["counts"]) for r in some]).astype(float), len(unique)).astype(np.int64)
        owner = np.zeros(len(unique), np.int64)
        owner[inverse[::-1]] = np.arange(len(inverse))[::-1]
        worth = total[inverse] >= (1 if n == 1 else 2)
        value = 2 * total[inverse] + (owner[inverse] == np.arange(len(inverse)))
        for r, a, b in zip(some, begins[:-1], begins[1:], strict=True):
            at = np.flatnonzero(worth[a:b])
            if len(at):
                out.append((r["block"], n, r["start"], steps(at), pack(value[a:b][at]), None))
        if n == 1:
            out.append((None, 0, 0, None, None, [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]))
    return _told(out)


class Root:
    """Probabilities of single tokens by their counts."""

    def __init__(self, tokens: int, types: int, once: int, twice: int):
        self.tokens, self.types = tokens, types
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - self.discount, self.discount * self.types) / self.tokens

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _spread(block: Block, told: list[dict], length: int, size: int) -> np.ndarray:
    """What a block was told of its entries of a length; 0 where nothing."""
    out = np.zeros(size, np.int64)
    for r in told:
        if r["length"] == length:
            out[r["start"] + unsteps(r["at"]).astype(np.int64)] = unpack(r["n"]).astype(np.int64)
    return out


def _known(group: pa.Table, depth: int) -> tuple[Block, int, list[dict], dict[int, np.ndarray]]:
    """The block of a group's pointer, its name, what it was told, and that as values of its n-grams."""
    rows = group.to_pylist()
    pointer, told = next(r for r in rows if r["path"] is not None), [r for r in rows if r["path"] is None]
    block = Block(pointer["path"], depth)
    return block, pointer["block"], told, {n: _spread(block, told, n, len(block.keys[n])) for n in range(1, depth + 1)}


def send_pairs(depth: int, buckets: int, root: Root) -> Callable:
    """A block's contexts, and what follows them in the n-grams that it owns: count and the suffix's probability."""

    def send(group: pa.Table) -> pa.Table:
        block, at, _, values = _known(group, depth)
        out = []
        for n in range(1, depth):
            counts, longer = values[n] >> 1, values[n + 1]
            asked = block.contexts(n, counts)
            slot = np.full(len(counts), -1, np.int64)
            slot[asked] = np.arange(len(asked))
            mine = np.flatnonzero((longer & 1 == 1) & (longer >= 4))
            # two n-grams of one hash may have a count that their contexts lack
            mine = mine[slot[block.rank[n][block.first[n + 1][mine] - 1]] >= 0]
            last = block.first[n + 1][mine]
            context = slot[block.rank[n][last - 1]]
            if n == 1:
                share = root.probability(values[1][block.rank[1][last]] >> 1)
            else:  # the same n-gram without its first word, over its own context
                share = (values[n][block.rank[n][last]] >> 1) / np.maximum(values[n - 1][block.rank[n - 1][last - 1]] >> 1, 1)
            order = np.argsort(context, kind="stable")
            context, number = context[order], (longer[mine] >> 1)[order]
            share = np.clip(np.round(-np.log(np.maximum(share[order], 1e-300)) * _Q), 0, 65535)
            per = np.bincount(context, minlength=len(asked))
            ends = np.cumsum(per)
            keys = block.keys[n][asked]
            bounds = bucket_bounds(keys, n, buckets)
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                own = slice(bounds[b], bounds[b + 1])
                pairs = slice(ends[own.start] - per[own.start], ends[own.stop - 1])
                out.append(_sent(b, at, n, own.start, steps(keys[own]), pack(per[own]), pack(number[pairs]), pack(counts[asked[own]][per[own] > 0]), pack(share[pairs])))
        return pa.Table.from_batches(out, schema=_sent(0, 0, 0, 0).schema)

    return send


def divergence(context: np.ndarray, number: np.ndarray, share: np.ndarray, whole: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """T of each context and the nats by which its distribution tells its followers better than its suffix's. context, number and share: of each symbol that followed twice or more, its context, its count and its probability after the suffix. whole: N of each context. What followed once is told by the suffix, at the discounted rate."""
    size = len(whole)
    free = np.maximum(whole - np.bincount(context, number - 1, size), 0)
    own, total = free[context] + prior, whole[context] + prior
    gain = np.bincount(context, number * np.log((number - 1 + own * share) / (total * share)), size)
    return free, gain + np.maximum(whole - np.bincount(context, number, size), 0) * np.log((free + prior) / (whole + prior))


def tell_states(gain: float) -> Callable:
    """The contexts of a bucket that stay, to each block that asked: one more than T."""

    def tell(sent: pa.Table) -> pa.Table:
        out, rows = [], sent.to_pylist()
        for n in sorted({r["length"] for r in rows}):
            some = [r for r in rows if r["length"] == n]
            unique, inverse, begins = _joined(some)
            per = np.concatenate([unpack(r["counts"]) for r in some]).astype(np.int64)
            number, total, share = (np.concatenate([unpack(r[c]) for r in some]).astype(float) for c in ("pairs", "whole", "shares"))
            whole = np.zeros(len(unique))
            whole[inverse[per > 0]] = total
            free, told = divergence(np.repeat(inverse, per), number, np.exp(-share / _Q), whole)
            stays = (told >= gain) & (whole > 0)
            for r, a, b in zip(some, begins[:-1], begins[1:], strict=True):
                at = np.flatnonzero(stays[inverse[a:b]])
                if len(at):
                    out.append((r["block"], -n, r["start"], steps(at), pack(free[inverse[a:b]][at] + 1), None))
        return _told(out)

    return tell


# --- scoring --------------------------------------------------------------------------------------------------------


def token_probabilities(block: Block, values: dict[int, np.ndarray], told: list[dict], depth: int, root: Root) -> np.ndarray:
    """The probability of each token by the longest context before it that stays; an inner one's smoothing passes through the shorter ones that stay."""
    out = root.probability(values[1][block.rank[1]] >> 1)
    for n in range(1, depth):
        counts = values[n] >> 1
        asked = block.contexts(n, counts)
        free = np.zeros(len(counts), np.int64)
        free[asked] = _spread(block, told, -n, len(asked))
        at = np.flatnonzero(block.place >= n)
        context = block.rank[n][at - 1]
        stays = free[context] > 0
        at, context = at[stays], context[stays]
        number = np.maximum((values[n + 1][block.rank[n + 1][at]] >> 1) - 1, 0)
        out[at] = (number + (free[context] - 1 + PRIOR) * out[at]) / (counts[context] + PRIOR)
    return out


def score_documents(docs: DataFrame, parts: int = 10, depth: int = DEPTH, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), parts).alias("held_out"))
    blocks = write_blocks(rows, f"{shared_folder(spark)}/weft-blocks-{uuid.uuid4().hex}")
    number, tokens = blocks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets = tokens // BUCKET_TOKENS + 1
    spread = blocks.coalesce(1).repartition(max(1, number))
    counts = kept(spread.mapInArrow(send_ngrams(depth, buckets), SENT).groupBy("bucket").applyInArrow(tell_counts, TOLD), "counts")
    sums = counts.filter("length = 0").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(4)]).first()
    root = Root(*sums)
    pointers = blocks.select("block", "path")
    told = counts.filter("length > 0").drop("sums")
    held = pointers.unionByName(told, allowMissingColumns=True)
    states = kept(held.groupBy("block").applyInArrow(send_pairs(depth, buckets, root), SENT).groupBy("bucket").applyInArrow(tell_states(gain), TOLD), "states")

    def score(group: pa.Table) -> pa.Table:
        block, _, said, values = _known(group, depth)
        seen, lengths = values[1][block.rank[1]] >> 1, block.counts
        logs = np.log10(np.maximum(token_probabilities(block, values, said, depth, root), 1e-300))
        ids, out = block.row.column("doc_id")[0].values, block.row.column("held_out")[0].values
        columns = [ids, out, pa.array(lengths), pa.array(by_row((seen > 0).astype(np.int64), lengths)), pa.array(np.full(len(lengths), root.tokens)), pa.array(by_row(root.base(seen), lengths)), pa.array(by_row(logs, lengths))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = held.unionByName(states.drop("sums"), allowMissingColumns=True)
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.groupBy("block").applyInArrow(score, schema)
