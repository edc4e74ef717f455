"""N-gram Jaccard join by vertical partitioning.

A document's set holds its distinct word shingles as hashes; the global order of shingles is the order of those hashes, and
fragments are ranges of it. Equal sets count once, by their content key, whatever number of documents has them.

1. The first fragment of each set, its share of the smallest hashes, is long enough that two linked sets share several
   shingles of it. Tasks collapse the shingles that they see in several sets, so that a passage of a third of all documents
   leaves each task as one row. Sets with too few shared shingles have no link and go no further.
2. The sets that are left are ordered anew, shingles of few sets before those of many, so that passages which many documents
   share come last. Two linked sets share a shingle of the first part of both. Sets that do are candidates, if enough of both
   is left from that shingle on and their sizes and marks (parities of hashed shingles) allow a link. In a few turns each shingle names some of its sets, and each set
   tries the nearest of those that its shingles name; sets that are linked so far are one component. Pairs of candidates in
   different components are made; each component first tries the pair of nearest marks, and then all pairs that are still
   between components are verified. So a group of thousands of near copies is linked by a few pairs for each, and no link
   between components is missed.
3. For each candidate pair every fragment of a fixed cut counts its partial overlap separately, and the counts are summed per pair.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle
is one shingle; repeated rows share a set; a null doc_id never names a component unless all ids of it are null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, mix, shingles, slices, words
from .components import components

SHARED = 0.12
#: Turns in which each set tries one set that its shingles name, before any pairs are made, and half of the sets that a shingle names.
TURNS = 2
HUBS = 4
#: Rounds in which each component tries one pair, before all that are left are verified.
ROUNDS = 1
PARTS = 8
MERGE_ROWS = 2_000_000
#: A shingle of so many sets comes late in the order of candidates; at most so many of the commonest go to every task.
COMMON = 4
COMMON_ROWS = 1_000_000
#: Longs of parity bits that a set is marked with: where two marks differ in more bits than linked sets do in shingles, there is no link.
MARKS = tuple(f"mark{k}" for k in range(4))
#: Most document ids that go to every task.
BROADCAST_ROWS = 1_000_000
_BITS = np.uint64(54)


def row_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, smallest first, row after row, and their number. At most 1024 rows."""
    hashes, _, _, counts = words(data, offsets)
    out, rows = shingles(hashes, counts, n)
    keys = np.sort(rows.astype(np.uint64) << _BITS | out >> np.uint64(10))
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & np.uint64((1 << 54) - 1), np.bincount((keys >> _BITS).astype(np.int64), minlength=len(counts))


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A content key of each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(77)))])
    ends = np.cumsum(sizes)
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def some_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, 1024):
        yield from slices(batch.slice(at, 1024))


def least(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles that a set shares with any that it is linked to."""
    return -(-percent * sizes // 100)


def own_share(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.floor(SHARED * sizes)).astype(np.int64)


def documents_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key (a hash of the text), set (content key; null if empty) and size of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in some_rows(batch):
                sets, sizes = row_sets(data, offsets, n)
                yield pa.record_batch([rows.column("doc_id"), rows.column("key"), pa.array(set_keys(sets, sizes), mask=sizes == 0), pa.array(sizes)], ["doc_id", "key", "set", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(measure, f"doc_id {kind}, key long, set long, size long")


def prefix_postings(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of two kinds. shingle and set: a shingle of a set's first fragment; set null: in several sets of a task. shared set, and shingle the set's key to deal it by: so many shingles of the set's fragment are in other sets of its task."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            hashes, sets = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((sets, hashes))
            hashes, sets = hashes[order], sets[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (sets[1:] != sets[:-1]))
            hashes, sets = hashes[new], sets[new]
            first = np.append(True, hashes[1:] != hashes[:-1])
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1
            keep = first | ~many
            names = ["shingle", "set", "shared"]
            yield pa.record_batch([pa.array(hashes[keep].view(np.int64)), pa.array(sets[keep], mask=many[keep]), pa.nulls(int(keep.sum()), pa.int64())], names)
            known, shared = np.unique(sets[many], return_counts=True)
            yield pa.record_batch([pa.array(known), pa.array(known), pa.array(shared.astype(np.int64))], names)

        for batch in batches:
            for _, data, offsets in some_rows(batch):
                sets, sizes = row_sets(data, offsets, n)
                ends = np.cumsum(sizes)
                take = np.arange(len(sets)) - np.repeat(ends - sizes, sizes) < np.repeat(sizes - least(sizes, percent) + own_share(sizes), sizes)
                if len(sets):
                    held.append((sets[take], np.repeat(set_keys(sets, sizes), sizes)[take]))
                if sum(len(h) for h, _ in held) > MERGE_ROWS:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(post, "shingle long, set long, shared long")


def survivors(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """set and size of the sets that share enough of their first fragment with other sets."""
    # each task has sent a shingle once if it saw it in several sets, and with its set otherwise: a group has a row or two for each task
    group = Window.partitionBy("shingle")
    posted = prefix_postings(docs, n, percent).select("shingle", "set", "shared", F.min("set").over(group).alias("low"), F.max("set").over(group).alias("high"), F.count_if(F.col("set").isNull()).over(group).alias("many"))
    counts = posted.filter("set IS NOT NULL AND (shared IS NOT NULL OR many > 0 OR low <> high)").groupBy("set").agg(F.sum(F.coalesce("shared", F.lit(1))).alias("shared"))
    sizes = members.filter(F.col("set").isNotNull()).groupBy("set").agg(F.max("size").alias("size"))
    needed = F.greatest(F.lit(1), F.floor(F.lit(SHARED) * F.ceil(F.lit(percent) * F.col("size") / 100)))
    return sizes.join(counts, "set").filter(F.col("shared") >= needed).select("set", "size")


def whole_sets(docs: DataFrame, members: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """set, size and shingles (array, smallest first) of the sets that are left, each once."""
    ids = members.join(left.select("set"), "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("none"))
    wanted = kept(ids.select("id").distinct(), "wanted")
    # ids of known number and small size spare a shuffle of all texts; more of them meet the texts in a shuffled join
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in some_rows(batch):
                sets, sizes = row_sets(data, offsets, n)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch([pa.array(set_keys(sets, sizes)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))], ["set", "size", "shingles"])

    found = texts.mapInArrow(collect, "set long, size long, shingles array<long>").filter("size > 0")
    found = kept(found.join(left.select("set"), "set", "left_semi"), "found")
    # copies of one set may stand under one id; a set is then kept once
    return found if found.groupBy("set").count().filter("count > 1").isEmpty() else found.dropDuplicates(["set"])


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most sets hold, smallest hash first, and in how many: those of COMMON sets or more, or of so many more that COMMON_ROWS of them stay."""
    counts = kept(sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().filter(F.col("count") >= COMMON), "common")
    # one row for each power of two decides how many sets make a shingle common
    levels = dict(counts.groupBy(F.floor(F.log2("count")).cast("int").alias("level")).count().collect())
    rows, least_count = 0, COMMON
    for level in sorted(levels, reverse=True):
        rows += levels[level]
        if rows > COMMON_ROWS:
            least_count = 2 << level
            break
    table = counts.filter(F.col("count") >= least_count).toArrow().sort_by("shingle")
    return table["shingle"].to_numpy().astype(np.uint64), table["count"].to_numpy().astype(np.int64)


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """signature, set, size, at and marks: the shingles that come first in a set, rare ones before common ones, and their places. Linked sets share one of them."""
    shared = sets.sparkSession.sparkContext.broadcast(common_shingles(sets))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            lists = batch.column("shingles")
            sizes, keys = np.diff(lists.offsets.to_numpy().astype(np.int64)), batch.column("set").to_numpy()
            values, row = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes)
            held = np.zeros(len(values), np.int64)
            if len(common):
                near = np.minimum(np.searchsorted(common, values), len(common) - 1)
                held = np.where(common[near] == values, counts[near], 0)
            order = np.lexsort((values, held, row))
            at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = at <= np.repeat(sizes - least(sizes, percent), sizes)
            bits = 64 * len(MARKS)
            odd = np.bincount(row * bits + (values % np.uint64(bits)).astype(np.int64), minlength=len(sizes) * bits) & 1
            marks = np.packbits(odd.astype(bool).reshape(len(sizes), bits), axis=1).view(np.int64)[row[first]]
            columns = [values[order][first].view(np.int64), keys[row[first]], sizes[row[first]], at[first], *(np.ascontiguousarray(m) for m in marks.T)]
            yield pa.record_batch([pa.array(c) for c in columns], ["signature", "set", "size", "at", *MARKS])

    return sets.select("set", "shingles").mapInArrow(sign, "signature long, set long, size long, at long, " + ", ".join(f"{m} long" for m in MARKS))


def differ(a: str, b: str) -> Column:
    """In how many bits the marks of two sets, under these prefixes of their columns, differ: never more than the shingles that only one of them holds."""
    return sum((F.bit_count(F.col(a + m).bitwiseXOR(F.col(b + m))) for m in MARKS), F.lit(0))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and marks allow a link."""
    na, nb = F.col(f"{a}size"), F.col(f"{b}size")
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (F.lit(100 + percent) * differ(a, b) <= F.lit(100 - percent) * (na + nb))


def enough(a: str, b: str, percent: int) -> Column:
    """Whether both sets have so many shingles left, from a shared one on, that they may be linked by it and those after it."""
    left = F.least(F.col(f"{a}size") - F.col(f"{a}at"), F.col(f"{b}size") - F.col(f"{b}at"))
    return F.lit(100 + percent) * left >= F.lit(percent) * (F.col(f"{a}size") + F.col(f"{b}size"))


def linked(pairs: DataFrame, sets: DataFrame, marks: DataFrame, percent: int, parts: int = PARTS) -> DataFrame:
    """The pairs (a, b) of which the sets are linked: overlaps counted by fragment and summed. Sizes and marks decide first."""
    side = lambda x: marks.select(F.col("set").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("size", *MARKS)))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link("a_", "b_", percent)).select("a", "b", F.col("a_size").alias("na"), F.col("b_size").alias("nb"))
    step = (1 << 54) // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(k.alias("part"), F.filter("shingles", lambda h: F.floor(h / F.lit(step)) == k).alias("held")))
    pieces = sets.select("set", F.explode(cut).alias("f")).select("set", "f.part", "f.held").filter(F.size("held") > 0)
    left = pieces.withColumnsRenamed({"set": "a", "held": "ha"})
    right = pieces.withColumnsRenamed({"set": "b", "held": "hb"})
    counted = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("shared"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return summed.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def tries(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """At most one pair (a, b) for each set: each shingle names up to 2 * HUBS of its sets, drawn anew each turn, and a set tries the one of nearest marks among all of other components that its shingles name."""
    lot = F.xxhash64("set", "signature", F.lit(turn))
    draw = F.struct(lot.alias("lot"), "component", "set", "size", "at", *MARKS)
    named = placed.groupBy("signature", F.pmod(lot, F.lit(HUBS)).alias("hub")).agg(F.min(draw).alias("low"), F.max(draw).alias("high"))
    met = placed.alias("p").join(named.alias("n"), "signature")

    def near(hub: str) -> Column:
        fits = (F.col("p.component") != F.col(f"{hub}component")) & enough("p.", hub, percent) & may_link("p.", hub, percent)
        return F.when(fits, F.struct(differ("p.", hub).alias("differ"), F.col(f"{hub}set").alias("other")))

    best = met.groupBy("p.set").agg(F.min(F.least(near("n.low."), near("n.high."))).alias("best")).filter("best IS NOT NULL")
    return best.select(F.least("set", "best.other").alias("a"), F.greatest("set", "best.other").alias("b")).distinct()


def set_components(sets: DataFrame, percent: int) -> DataFrame:
    """node and component of the sets that are linked to another."""
    signed = kept(rare_first(sets, percent), "signatures")
    marks = signed.filter("at = 0").select("set", "size", *MARKS)
    shared = signed.groupBy("signature").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low <> high").select("signature")
    placed = kept(signed.join(shared, "signature").withColumn("component", F.col("set")), "placed")
    found = groups = None
    for turn in range(TURNS):
        tried = kept(tries(placed, turn, percent), "tried")
        links = linked(tried, sets, marks, percent)
        found = kept(links if found is None else found.unionByName(links).distinct(), "links")
        groups = components(found)
        # only shingles of sets in different components are looked at again; a set without links is its own component
        named = placed.drop("component").join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        several = named.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("signature")
        placed = kept(named.join(several, "signature"), "placed")
    # all pairs that are still between components; the first shingle that two linked sets share stands where enough of both is left
    fits = (F.col("p.component") < F.col("q.component")) & enough("p.", "q.", percent) & may_link("p.", "q.", percent)
    pairs = placed.alias("p").join(placed.alias("q"), (F.col("p.signature") == F.col("q.signature")) & fits)
    pairs = kept(pairs.select(F.least("p.set", "q.set").alias("a"), F.greatest("p.set", "q.set").alias("b"), differ("p.", "q.").alias("differ")).distinct(), "pairs")
    # in each round every component tries its nearest pair by marks; what is then still between two components is verified whole
    for last in (False,) * ROUNDS + (True,):
        names = groups.select(F.col("node"), F.col("component"))
        pairs = pairs.join(names.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(names.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
        pairs = pairs.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")
        now = pairs.select("a", "b")
        if not last:
            pairs = kept(pairs, "pairs")
            ends = pairs.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("differ", "a", "b").alias("nearest"))
            now = kept(ends.groupBy("c").agg(F.min("nearest").alias("nearest")).select("nearest.a", "nearest.b").distinct(), "tried")
            pairs = pairs.select("a", "b", "differ").join(now, ["a", "b"], "left_anti")
        found = kept(found.unionByName(linked(now, sets, marks, percent)), "links")
        groups = components(found)
    return groups


def grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, key, size and group of each row: rows of a group are linked, a row without words has none. Sets are linked when percent of their union is shared."""
    members = kept(documents_sets(docs, n), "members")
    left = kept(survivors(docs, members, n, percent), "survivors")
    sets = kept(whole_sets(docs, members, left, n), "sets")
    groups = set_components(sets, percent)
    return members.join(groups.withColumnRenamed("node", "set"), "set", "left").select("doc_id", "key", "size", F.coalesce("component", "set").alias("group"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, its own included) of each row."""
    placed = grouped(docs, n, percent)
    names = placed.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("component_id"))
    # only a group of several rows needs a look at its name; a row without a set is alone
    return placed.join(names, "group", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, all columns: that of the smallest doc_id (null last), then of the smallest hash of its text. Rows without words stay. A row is known by doc_id and text, so rows of equal ids don't hide one another; of rows that are equal in both one stays."""
    columns = docs.columns
    placed = kept(grouped(docs, n, percent).filter(F.col("group").isNotNull()), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "key")
    several = placed.groupBy("group").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # the first row of a group may stand several times; it alone is then looked at once more
    gone = placed.join(several, "group").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))
    fate = kept(gone.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("stays").alias("_stays")), "fate")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    marked = docs.join(fate.select("_id", "_key", "_stays"), same, "left")
    left = marked.filter("_key IS NULL").select(*[F.col(f"`{c}`") for c in columns])
    if fate.filter("_stays").isEmpty():
        return left
    twice = docs.join(fate.filter("_stays"), same).dropDuplicates(["_id", "_key"])
    return left.unionByName(twice.select(*[F.col(f"`{c}`") for c in columns]))
