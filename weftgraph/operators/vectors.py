"""TF-IDF vectors in long form, sparse similarity joins and rankings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_SCORE, TOP_K
from ..functions import words as W
from ..tables import stored


#: Tokens that go to every task with their idf: the commonest. All others meet theirs in a join.
COMMON = 100_000
#: Tokens of queries that go to every task; of more of them, documents meet the queries in a join.
ASKED = 1_000_000
#: Rows that a task gathers before it hands them on, and tokens that it counts before it does.
_ROWS, _COUNTED = 1 << 17, 1 << 18


def repeated(texts: DataFrame) -> bool:
    """Whether several texts have one id."""
    return not texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def term_counts(texts: DataFrame, rule: str = "tokens") -> DataFrame:
    """id, token, n and size (all tokens of the text); texts: id, text. A text is counted where it is read, only ids that stand several times are brought together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, numbers, sizes = [], [], [], []

            def out() -> pa.RecordBatch:
                columns = [batch.column("id").take(pa.array(np.repeat(np.array(rows, np.int64), sizes_of))), W.strings(tokens), pa.array(numbers, pa.int64()), pa.array(np.repeat(np.array(sizes, np.int64), sizes_of))]
                return pa.record_batch(columns, ["id", "token", "n", "size"])

            sizes_of: list[int] = []
            for row, found in enumerate(W.words(batch.column("text").to_pylist(), rule)):
                counts = Counter(found)
                rows.append(row)
                sizes.append(len(found))
                sizes_of.append(len(counts))
                tokens += counts.keys()
                numbers += counts.values()
                if len(tokens) >= _ROWS:
                    yield out()
                    for held in (rows, tokens, numbers, sizes, sizes_of):
                        held.clear()
            if tokens:
                yield out()

    kind = texts.schema["id"].dataType.simpleString()
    counts = texts.select("id", "text").mapInArrow(run, f"id {kind}, token string, n long, size long")
    return counts.groupBy("id", "token", "size").agg(F.sum("n").alias("n")) if repeated(texts) else counts


def _with_idf(counted: DataFrame, texts: DataFrame) -> DataFrame:
    total = texts.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("token", "df", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def idf(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """token, df and idf = ln((1 + N) / (1 + df)) + 1; N counts texts without tokens too."""
    return _with_idf(counts.groupBy("token").agg(F.count("*").alias("df")), texts)


def frequencies(texts: DataFrame) -> DataFrame:
    """The same of texts that are not counted yet: a task sends a token once for all of its texts, or for some hundred thousand tokens of them."""
    if repeated(texts):
        return idf(term_counts(texts), texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([W.strings(list(counts)), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for found in W.words(batch.column("text").to_pylist(), "tokens"):
                counts.update(set(found))
                if len(counts) >= _COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return _with_idf(texts.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("df")), texts)


def vectors(texts: DataFrame) -> DataFrame:
    """id, token and weight. Texts are tokenised once: the counts are stored, as frequencies and weights both need them."""
    counts = stored(term_counts(texts))
    return weights(counts, idf(counts, texts))


def weights(counts: DataFrame, frequencies: DataFrame) -> DataFrame:
    return counts.join(frequencies, "token").select("id", "token", (F.col("n") / F.col("size") * F.col("idf")).alias("weight"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def query_vectors(queries: DataFrame, frequencies: DataFrame) -> DataFrame:
    """id, token and weight of queries against a corpus's idf; a token that the corpus lacks has idf ln 2."""
    return term_counts(queries).join(frequencies.select("token", "idf"), "token", "left").select("id", "token", (F.col("n") / F.col("size") * F.coalesce("idf", F.lit(math.log(2)))).alias("weight"))


def cosine_pairs(weights: DataFrame) -> DataFrame:
    """source < target and score of all pairs of ids that share a token, by an inverted index."""
    unit = weights.join(norms(weights), "id").select("id", "token", (F.col("weight") / F.col("norm")).alias("w"))
    a, b = unit.select(F.col("id").alias("source"), "token", F.col("w").alias("wa")), unit.select(F.col("id").alias("target"), "token", F.col("w").alias("wb"))
    return a.join(b, "token").filter("source < target").groupBy("source", "target").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def ranked(scores: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """The k best items of each key, ties by item; scores are compared at nine digits."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), item)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def similar_edges(pairs: DataFrame, k: int = TOP_K, least: float = MIN_SCORE) -> DataFrame:
    """source < target and score: each node's k best neighbours of at least this score, both directions united."""
    if k < 1 or not 0 <= least <= 1:
        raise ValueError("k must be 1 or more, least between 0 and 1")
    both = pairs.select("source", "target", "score").unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), "score"))
    best = ranked(both.filter(F.col("score") >= least), "source", "target", k)
    return best.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.round("score", 4).alias("score")).distinct()


def _measured(docs: DataFrame, known: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """id, size, norm, and of the asked tokens that a text holds, at (their places) and w (weights), of each text; ids are different. Each text is counted once where it is read: common tokens have their idf there, the rest is joined and summed. known: token, idf."""
    near = known.orderBy(F.desc("df")).limit(COMMON).select("token", "idf").toArrow()
    common = dict(zip((t.encode() for t in near["token"].to_pylist()), near["idf"].to_pylist(), strict=True))
    places = {t.encode(): k for k, t in enumerate(asked or [])}
    shared = docs.sparkSession.sparkContext.broadcast((common, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            rows, size, sq, rare, times, at, count = columns

            def out() -> pa.RecordBatch:
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]), pa.int32()), kind([v for r in x for v in r]))
                values = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), pa.array(sq, pa.float64()), lists(rare, W.strings), lists(times, lambda v: pa.array(v, pa.int64())), lists(at, lambda v: pa.array(v, pa.int32())), lists(count, lambda v: pa.array(v, pa.int64()))]
                return pa.record_batch(values, ["id", "size", "sq", "rare", "times", "at", "count"])

            for row, found in enumerate(W.words(batch.column("text").to_pylist(), "tokens")):
                counts = Counter(found)
                here = np.array([common.get(t, 0.0) for t in counts])
                weights = np.array(list(counts.values()), np.float64) / max(len(found), 1) * here
                others = [(t, n) for t, n in counts.items() if t not in common] if not here.all() else []
                met = [(places[t], n) for t, n in counts.items() if t in places] if places else []
                for held, value in zip(columns, (row, len(found), float(weights @ weights), [t for t, _ in others], [n for _, n in others], [k for k, _ in met], [n for _, n in met]), strict=True):
                    held.append(value)
                if len(rows) >= 1024:
                    yield out()
                    for held in columns:
                        held.clear()
            if rows:
                yield out()

    kind = docs.schema["id"].dataType.simpleString()
    told = stored(docs.select("id", "text").mapInArrow(run, f"id {kind}, size long, sq double, rare array<string>, times array<long>, at array<int>, count array<long>"))
    each = told.select("id", "size", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("id", F.col("r.rare").alias("token"), (F.col("r.times") / F.col("size")).alias("tf"))
    rest = each.join(known.select("token", "idf"), "token").groupBy("id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")).alias("rest"))
    return told.join(rest, "id", "left").select("id", "size", F.sqrt(F.col("sq") + F.coalesce("rest", F.lit(0.0))).alias("norm"), "at", "count")


def text_norms(docs: DataFrame) -> DataFrame:
    """id and norm of each text's vector; texts without tokens have none."""
    if repeated(docs):
        return norms(vectors(docs))
    return _measured(docs, stored(frequencies(docs))).filter("size > 0").select("id", "norm")


class _Asked:
    """Weights of queries by token, for all of a task's texts at once."""

    def __init__(self, q: pa.Table, tokens: pa.Array):
        names = pc.unique(q["query_id"])
        where = pc.index_in(q["token"], tokens).to_numpy().astype(np.int64)
        order = np.argsort(where, kind="stable")
        self.ids, self.begin = names, np.searchsorted(where[order], np.arange(len(tokens) + 1))
        self.query = pc.index_in(q["query_id"], names).to_numpy().astype(np.int64)[order]
        self.weight = q["wq"].to_numpy()[order]

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, scores and shares (a row for each text, a column for each query) of some rows at a time."""
        wide = len(self.ids)
        step = max(16, (1 << 20) // max(wide, 1))
        for first in range(0, batch.num_rows, step):
            some = batch.slice(first, step)
            lists, counts = some.column("at"), some.column("count")
            row = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists).to_numpy())
            at, n = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
            idf = some.column("idf").flatten().to_numpy()
            size, norm = some.column("size").to_numpy(), some.column("norm").to_numpy()
            weight = n / size[row] * idf / norm[row]
            width = self.begin[at + 1] - self.begin[at]
            spot = np.repeat(self.begin[at] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            place = np.repeat(row, width) * wide + self.query[spot]
            shape = (some.num_rows, wide)
            score = np.bincount(place, np.repeat(weight, width) * self.weight[spot], some.num_rows * wide).reshape(shape)
            yield first, score, score > 0


def _asked(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, object] | None:
    """Texts with their norm and their weights of asked tokens, and the queries' weights for every task; none if queries are too many or ids of texts repeat."""
    if repeated(docs):
        return None
    known = stored(frequencies(docs))
    q = query_vectors(queries, known)
    q = stored(q.join(norms(q), "id").select(F.col("id").alias("query_id"), "token", (F.col("weight") / F.col("norm")).alias("wq")))
    if q.count() > ASKED:
        return None
    told = q.select("token").distinct().join(known.select("token", "idf"), "token", "left").toArrow()
    tokens, idfs = told["token"].combine_chunks(), told["idf"].to_numpy()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((_Asked(q.toArrow().combine_chunks(), tokens), idfs))
    return stored(_measured(docs, known, tokens.to_pylist())), shared


def _score(batch: pa.RecordBatch, shared) -> tuple[_Asked, pa.RecordBatch]:
    asked, idfs = shared.value
    lists = batch.column("at")
    idf = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]), pa.int32()), pa.array(idfs[lists.flatten().to_numpy()] if lists.flatten() else np.zeros(0)))
    return asked, batch.append_column("idf", idf)


def query_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, id and score of each query and each document that share a token. Documents of score 0 are left to with_zeros. Queries go to every task, which scores its texts for all of them; of very many queries, tokens meet in a join."""
    met = _asked(queries, docs)
    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    if met is None:
        return _joined_scores(queries, docs)
    told, shared = met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, held = _score(batch, shared)
            for first, score, some in asked.scores(held):
                row, q = np.nonzero(some)
                yield pa.record_batch([asked.ids.take(pa.array(q)), batch.column("id").take(pa.array(row + first)), pa.array(score[row, q])], ["query_id", "id", "score"])

    return told.mapInArrow(run, kinds)


def query_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score and rank: the k best documents of each query, filled up with documents of score 0 in id order. A task keeps k of a query."""
    met = _asked(queries, docs)
    if met is None:
        return ranked(with_zeros(_joined_scores(queries, docs), queries, docs, k), "query_id", "id", k)
    told, shared = met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        asked = None
        for batch in batches:
            asked, held = _score(batch.take(pc.array_sort_indices(batch.column("id"))), shared)
            ids = held.column("id")
            for first, score, _ in asked.scores(held):
                near = np.round(score, 9)
                for _ in range(min(k, len(near))):
                    row = near.argmax(axis=0)
                    columns = np.arange(near.shape[1])
                    for q, i, x in zip(columns.tolist(), ids.take(pa.array(row + first)).to_pylist(), score[row, columns].tolist(), strict=True):
                        best.setdefault(q, []).append((-round(x, 9), i, x))
                    near[row, columns] = -1
                for held_best in best.values():
                    held_best.sort()
                    del held_best[k:]
        if asked is not None:
            rows = [(q, i, x) for q, held in best.items() for _, i, x in held]
            yield pa.record_batch([asked.ids.take(pa.array([q for q, _, _ in rows], pa.int64())), pa.array([i for _, i, _ in rows], ids.type), pa.array([x for _, _, x in rows], pa.float64())], ["query_id", "id", "score"])

    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    found = told.mapInArrow(run, kinds)
    # a query without tokens has no score with any document
    silent = queries.select("id").join(term_counts(queries).select("id").distinct(), "id", "left_anti").select(F.col("id").alias("query_id"))
    none = silent.crossJoin(docs.select("id").orderBy("id").limit(k)).select("query_id", "id", F.lit(0.0).alias("score"))
    return ranked(found.unionByName(none), "query_id", "id", k)


def _joined_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    counts = stored(term_counts(docs))
    frequencies = stored(idf(counts, docs))
    q = query_vectors(queries, frequencies)
    q = stored(q.join(norms(q), "id").select(F.col("id").alias("query_id"), "token", (F.col("weight") / F.col("norm")).alias("wq")))
    told = weights(counts, frequencies)
    # the queries' few tokens thin out the postings before any score is summed
    dots = told.join(q, "token").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("wq")).alias("dot"))
    return dots.join(norms(told), "id").select("query_id", "id", (F.col("dot") / F.col("norm")).alias("score"))


def with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Scores, and for each query the first k documents in id order at 0, so that a ranking of k is always full."""
    first = docs.select("id").orderBy("id").limit(k).crossJoin(queries.select(F.col("id").alias("query_id")))
    missing = first.join(scores, ["query_id", "id"], "left_anti")
    return scores.unionByName(missing.select("query_id", "id", F.lit(0.0).alias("score")))


def _norms(v: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The length of each given vector; NaN where a cosine with it is none, as of a vector of zeros."""
    size = np.sqrt(np.einsum("ij,ij->i", v, v))
    size[given & ~((size > 0) & (size < np.inf))] = np.nan
    return size


def _first_of_equals(ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of those vectors that can be among the k best of a query: of equal ones (keys) the k + 1 smallest ids, k rows of each, as a query passes over its own id."""
    order = np.lexsort((ids, keys))
    key, own = keys[order], ids[order]
    new_key = np.append(True, key[1:] != key[:-1])
    new_id = new_key | np.append(True, own[1:] != own[:-1])
    turn = np.cumsum(new_id)
    nth_id = turn - np.maximum.accumulate(np.where(new_key, turn, 0))
    at = np.arange(len(order))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return order[(nth_id <= k) & (nth_row < k)]


def _best(q: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: scores at nine digits, NaN first, -inf (no vector) last, ties by id."""
    compared = np.where(np.isnan(score), np.inf, np.round(score, 9))
    order = np.lexsort((ids[at], -compared, q))
    first = np.append(True, q[order][1:] != q[order][:-1])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[nth < k]


def cell_topk(qids: np.ndarray, q: np.ndarray, q_given: np.ndarray, ids: np.ndarray, v: np.ndarray, v_given: np.ndarray, k: int, tile: tuple[int, int] = (1024, 4096)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place of the vector, and score of the k best vectors (ids, v) of each query (qids, q) by cosine; a row that isn't given has no vector. Scores are exact: products of single precision only sift the pairs, by a bound of their error."""
    qn, vn = _norms(q, q_given), _norms(v, v_given)
    keys = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, 8 * v.shape[1]))).ravel(), return_inverse=True)[1].ravel() if len(v) and v.shape[1] else np.zeros(len(v), np.int64)
    keys[~v_given], keys[v_given & np.isnan(vn)] = -1, -2
    left = _first_of_equals(ids, keys, k)
    odd, good = left[~v_given[left] | np.isnan(vn[left])], left[v_given[left] & ~np.isnan(vn[left])]
    unit = (v[good] / vn[good, None]).astype(np.float32)
    slack = np.float32((v.shape[1] + 8) * 2.0**-22)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of different ids, with their scores."""
        other = qids[rows] != ids[at]
        rows, at = rows[other], at[other]
        score = np.empty(len(rows))
        for n in range(0, len(rows), 1 << 16):
            r, a = rows[n : n + (1 << 16)], at[n : n + (1 << 16)]
            score[n : n + (1 << 16)] = np.einsum("ij,ij->i", q[r], v[a]) / (qn[r] * vn[a])
        score[~(q_given[rows] & v_given[at])] = -np.inf
        return rows, at, score

    plain = np.flatnonzero(q_given & ~np.isnan(qn))
    for n in range(0, len(plain), tile[0]):
        rows = plain[n : n + tile[0]]
        asked = (q[rows] / qn[rows, None]).astype(np.float32)
        held = keep(np.repeat(rows, len(odd)), np.tile(odd, len(rows)))
        least = np.full(len(rows), -np.inf, np.float32)
        for m in range(0, len(good), tile[1]):
            some = good[m : m + tile[1]]
            near = asked @ unit[m : m + tile[1]].T
            if not m and len(some) > 2 * k:
                # the k best of the first ones are a floor for the rest; as many more are looked at as a query's own id may have rows
                own = np.where(qids[rows][:, None] == ids[some][None, :512], -np.inf, near[:, :512])
                least = np.partition(own, -k, axis=1)[:, -k] if own.shape[1] > k else least
            r, a = np.nonzero(near >= (least - slack)[:, None])
            more = keep(rows[r], some[a])
            held = tuple(np.concatenate(x) for x in zip(held, more, strict=True))
            best = _best(*held, ids, k)
            held = tuple(x[best] for x in held)
            full, count = np.unique(held[0], return_counts=True)
            worst = np.full(len(q), -np.inf)
            np.minimum.at(low := np.full(len(q), np.inf), held[0], np.where(np.isnan(held[2]), np.inf, held[2]))
            worst[full[count == k]] = low[full[count == k]]
            least = np.maximum(least, worst[rows].astype(np.float32))
        if not len(good):
            held = tuple(x[best] for best in [_best(*held, ids, k)] for x in held)
        found.append(held)
    # a query without a cosine has the smallest ids, those of given vectors first if it is given itself
    for rows in (np.flatnonzero(~q_given), np.flatnonzero(q_given & np.isnan(qn))):
        if len(rows):
            is_given = q_given[rows[0]]
            group = np.where(v_given, 1, 0) if is_given else np.zeros(len(v), np.int64)
            first = _first_of_equals(ids, group, k)
            for n in range(0, len(rows), 4096):
                held = keep(np.repeat(rows[n : n + 4096], len(first)), np.tile(first, len(rows[n : n + 4096])))
                best = _best(*held, ids, k)
                found.append(tuple(x[best] for x in held))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, at, score


def dense_cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1 << 15) -> DataFrame:
    """query_id, id, rank: nearest dense vectors (id, v: numbers) of each query (id, v), whose own id is passed over. Queries and vectors are dealt into blocks of about block rows at most, and each pair of blocks is a task that keeps k of a query. A pair without a vector has no score and is last, one with a vector of zeros has NaN and is first."""
    counts = queries.agg(F.count("*")).first()[0], vectors.agg(F.count("*")).first()[0]
    # small tables are dealt too, so that all cores have some; a row goes to as many tasks as the other side has blocks
    dealt = [max(1, -(-n // block), min(8, -(-n // 1024))) for n in counts]
    name = lambda c, to: F.pmod(F.xxhash64("id", F.lit(to)), F.lit(c)).cast("int")
    number = "array<double>" if "double" in vectors.schema["v"].dataType.simpleString() + queries.schema["v"].dataType.simpleString() else "array<float>"
    all_of = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    asked = queries.select(F.lit(True).alias("asks"), "id", F.col("v").cast(number).alias("v"), name(dealt[0], 0).alias("qb"), F.explode(all_of(dealt[1])).alias("vb"))
    held = vectors.select(F.lit(False).alias("asks"), "id", F.col("v").cast(number).alias("v"), F.explode(all_of(dealt[0])).alias("qb"), name(dealt[1], 1).alias("vb"))
    kind = vectors.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        given = pc.is_valid(table["v"]).to_numpy()
        size = max(pc.max(pc.list_value_length(table["v"])).as_py() or 0, 1)
        if not pc.all(pc.equal(pc.list_value_length(table["v"]), size)).as_py() and given.any():
            raise ValueError("vectors differ in length")
        v = np.zeros((len(given), size))
        v[given] = pc.list_flatten(table["v"]).to_numpy().reshape(-1, size)
        ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        rows, at, score = cell_topk(ids[asks], v[asks], given[asks], ids[~asks], v[~asks], given[~asks], k)
        none = np.isneginf(score)
        return pa.table({"query_id": ids[asks][rows], "id": ids[~asks][at], "score": pa.array(np.where(none, 0.0, score), pa.float64(), mask=none)})

    found = asked.unionByName(held).groupBy("qb", "vb").applyInArrow(run, f"query_id {kind}, id {kind}, score double")
    return ranked(found, "query_id", "id", k)
