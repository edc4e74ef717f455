"""URL filters: rules first, then a model of segmented host and path words.

A rule names a host, which stands for all its subdomains, and a path prefix; the longest that fits decides. Other URLs go
to the model: delimited parts of the host and path are split into words by unigram Viterbi, and multinomial naive Bayes,
trained here on a small list of labelled names, scores the words. A word outside both lists counts as an unknown word for
either class. Word counts of the segmentation are the labelled list, a list of common words and the parts of all hyphenated
names at hand, of any number and length.

Tasks hold the most frequent of these parts. The rest stays in a table, and a URL gets those of its runs that are in it by
a join: its substrings of the rest's lengths, sifted by a bitmap of the rest's hashes, meet the rest on the word itself. So
every URL is split as if all parts were held; numbers held and bits of the map decide only how much is joined.

Parts are runs of letters and digits of any script; bare numbers say nothing and are passed over, and single letters of
names are no evidence of words.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; repeated rows
and null ids are judged like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

#: Names of hosts that a filter of training data blocks or allows, words joined as such names join them.
BLOCKED = """casino win online casino free bets sports betting poker room slots jackpot cheap pills buy viagra pharmacy discount meds
adult x xxx videos porn tube sex cams hot girls nude escorts ads track ad tracker click bait pop ads banner ads spam farm link farm seo spam
payday loans fast cash get rich quick replica watches fake bags crack keygen warez torrent free download hacks malware phishing miracle diet
weight loss pills crypto giveaway win prize lottery bonus gambling bet365 roulette blackjack stream free movies""".split("\n")
ALLOWED = """news daily times science journal university library school education open data health clinic hospital city council government
weather report travel guide recipes kitchen garden home music archive history museum art gallery book review language dictionary wiki
encyclopedia research institute software docs developer forum blog photo camera sports club football league chess puzzle math physics
biology chemistry local community church charity green energy car repair bicycle railway airport hotel restaurant market farm fresh
web mail shop store free software track field press education article""".split("\n")
#: Common words of names, for segmentation only; rarer ones come from the URLs.
COMMON = "a about all and best big blue book city day eu first for free fun game go good great group help hot in info it life live lab man me media my net new now of on one online our out own page people red site social star super team tech the time to today top town tv up us video web word work world you your".split()
#: Rule: verdict, host, path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UNKNOWN_PER_LETTER = 10.0
#: Parts of names that each task holds, of at most so many characters (those of a DNS label); the others are joined.
HELD_PARTS, HELD_CHARACTERS = 20_000, 63
#: Runs whose splits a task remembers.
REMEMBERED = 50_000
#: Bits of the map for each joined part, and the most of all, as a power of two.
BITS_PER_PART, MOST_BITS = 16, 27
#: Bits in one row of Spark's bitmaps.
BITMAP_ROW = 32_768
#: Parts of hosts and paths that say nothing of what a site is.
NEUTRAL_PARTS = frozenset("www m blog com org net example co en de fr es html htm php page index".split())


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one is asked before the shorter
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(prefix)
        name, verdict = F.when(fits, at + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Splits a run of letters into the words of the highest product of unigram probabilities. A run between words may be unknown, whatever its length.

    counts are the words held, rest the sum of the counts of all others and lengths the others' lengths.
    """

    def __init__(self, counts: dict[str, int], rest: int = 0, lengths: Iterable[int] = ()):
        self.total = sum(counts.values()) + rest + 1
        self.cost = {w: self.known(n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}.union(lengths))
        self.remembered: dict[str, tuple[str, ...]] = {}

    def known(self, count: int) -> float:
        return -math.log(count / self.total)

    def unknown(self, length: int) -> float:
        return UNKNOWN_PER_LETTER + 4.0 * length

    def split(self, text: str, others: dict[str, float] | None = None) -> tuple[str, ...]:
        """The words of text. others: the costs of all words in it that are not held, and of any more; so a text has one split."""
        found = self.remembered.get(text)
        if found is None:
            found = self._split(text, others or {})
            if len(text) <= HELD_CHARACTERS:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[text] = found
        return found

    def _split(self, text: str, others: dict[str, float]) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        start = 0  # of the cheapest unknown run that ends here, and so of any that ends later, as costs grow by the letter
        for end in range(1, len(text) + 1):
            least = (best[start][0] + self.unknown(end - start), start)
            for n in self.lengths:
                if n > end:
                    break
                word = text[end - n : end]
                cost = self.cost.get(word)
                if word in others:
                    cost = others[word]
                if cost is not None:
                    least = min(least, (best[end - n][0] + cost, end - n))
            best.append(least)
            if least[0] + self.unknown(1) < best[start][0] + self.unknown(end + 1 - start):
                start = end
        out, end = [], len(text)
        while end:
            out.append(text[best[end][1] : end])
            end = best[end][1]
        return tuple(out[::-1])


class NaiveBayes:
    """Multinomial naive Bayes over words, add-one smoothed; log odds of class 1. Unknown words add nothing."""

    def __init__(self, docs: list[tuple[list[str], int]]):
        counts = (Counter(), Counter())
        for words, label in docs:
            counts[label].update(words)
        known = set(counts[0]) | set(counts[1])
        total = [sum(c.values()) for c in counts]
        self.weight = {w: math.log((counts[1][w] + 1) / (total[1] + len(known))) - math.log((counts[0][w] + 1) / (total[0] + len(known))) for w in known}

    def odds(self, words: list[str]) -> float:
        return sum(self.weight.get(w, 0.0) for w in words)


def parts(host: str, path: str) -> list[str]:
    """Runs of letters and digits of any script, without bare numbers and neutral parts."""
    return [p for p in re.split(r"[\W_]+", f"{host}/{path.lower()}") if p and not p.isdecimal() and p not in NEUTRAL_PARTS]


class UrlModel:
    def __init__(self, counts: dict[str, int], rest: int = 0, lengths: Iterable[int] = ()):
        self.listed = Counter({w: 1 for w in COMMON})
        for w in " ".join(BLOCKED + ALLOWED).split():
            self.listed[w] += 20
        for w in COMMON:
            self.listed[w] += 5
        self.segment = Segmenter(dict(Counter(counts) + self.listed), rest, lengths)
        self.bayes = NaiveBayes([(line.split(), 1) for line in BLOCKED] + [(line.split(), 0) for line in ALLOWED])

    def words(self, host: str, path: str, others: Iterable[tuple[str, int]] = ()) -> list[str]:
        """others: the words that are not held, with their counts, among them all that the URL contains."""
        costs = {w: self.segment.known(n + self.listed[w]) for w, n in others}
        return [w for p in parts(host, path) for w in self.segment.split(p, costs)]

    def odds(self, host: str, path: str) -> float:
        return self.bayes.odds(self.words(host, path))


def part_counts(urls: DataFrame) -> DataFrame:
    """w and n, its weight, of all parts of two characters or more of all hyphenated names in hosts, which are words as their owners split them. A name without a hyphen may be several words, so it is no evidence of one."""
    names = urls.select(F.explode(F.split("host", r"[.]")).alias("name")).filter(F.contains("name", F.lit("-")))
    found = names.select(F.explode(F.split("name", r"[^\p{L}\p{N}]+")).alias("w")).filter((F.length("w") >= 2) & ~F.col("w").rlike(r"^\p{N}+$"))
    return found.groupBy("w").agg(F.greatest(F.lit(1), F.rint(5 * F.log1p(F.count("*")))).cast("long").alias("n"))


class Vocabulary(NamedTuple):
    """All parts of names: the most frequent ones held, the others a table (None if there are none) with their number, sum of weights and lengths."""

    held: dict[str, int]
    others: DataFrame | None = None
    number: int = 0
    weight: int = 0
    lengths: tuple[int, ...] = ()


def vocabulary(counts: DataFrame, most: int = HELD_PARTS) -> Vocabulary:
    long = F.length("w") > HELD_CHARACTERS
    first = counts.select(F.when(~long, F.col("w")).alias("w"), "n").orderBy(F.col("w").isNull(), F.desc("n"), "w").limit(most + 1).collect()
    held = {r["w"]: r["n"] for r in first[:most] if r["w"] is not None}
    if len(held) == len(first):
        return Vocabulary(held)
    if held:
        last, n = list(held.items())[-1]
        counts = counts.filter(long | (F.col("n") < n) | ((F.col("n") == n) & (F.col("w") > last)))
    others = kept(counts, "parts")
    number, weight, lengths = others.agg(F.count("*"), F.sum("n"), F.collect_set(F.length("w"))).first()
    return Vocabulary(held, others, number, weight, tuple(sorted(lengths)))


def bitmap(words: DataFrame, bits: int) -> bytes:
    """Bit crc32(w) mod 2^bits is set for each w. bits: 15 or more."""
    at = F.crc32(F.col("w").cast("binary")) % F.lit(1 << bits)
    out = bytearray(1 << (bits - 3))
    for row, found in words.groupBy(F.floor(at / BITMAP_ROW).alias("row")).agg(F.bitmap_construct_agg(at % BITMAP_ROW)).collect():
        out[row * BITMAP_ROW // 8 : (row + 1) * BITMAP_ROW // 8] = found
    return bytes(out)


def joined_parts(urls: DataFrame, words: Vocabulary) -> DataFrame:
    """key, a hash of host and path, and others, an array of (w, n): all parts of names that the URLs of that key contain and tasks do not hold."""
    bits = min(MOST_BITS, max(15, (BITS_PER_PART * words.number - 1).bit_length()))
    marks, held, lengths = bitmap(words.others, bits), words.held, words.lengths

    def marked(text: str) -> Iterator[str]:
        for n in lengths:
            for k in range(len(text) - n + 1):
                word = text[k : k + n]
                at = crc32(word.encode()) & ((1 << bits) - 1)
                if marks[at >> 3] >> (at & 7) & 1 and word not in held:
                    yield word

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found = [], []
        for batch in batches:
            for key, host, path in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "path")), strict=True):
                some = {w for p in set(parts(host, path)) for w in marked(p)}
                keys += [key] * len(some)
                found += some
                if len(keys) >= 10_000:
                    yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["key", "w"])
                    keys, found = [], []
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["key", "w"])

    pairs = urls.select("key", "host", "path").distinct().mapInArrow(candidates, "key long, w string")
    # URLs that share a key get the words of both, and a word that a URL lacks does nothing
    return pairs.join(words.others, "w").groupBy("key").agg(F.collect_set(F.struct("w", "n")).alias("others"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, held: int = HELD_PARTS) -> DataFrame:
    """page_id, host, path, rule, verdict, words (space-joined segments) and odds (log odds of block) of each row. held: parts of names that each task holds, the results are the same for any number."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    vocab = vocabulary(part_counts(urls), held)
    if vocab.others is None:
        urls = urls.withColumn("others", F.lit(None).cast("array<struct<w:string,n:long>>"))
    else:
        urls = urls.withColumn("key", F.xxhash64("host", "path"))
        urls = urls.join(joined_parts(urls, vocab), "key", "left").drop("key")
    counts, weight, lengths = vocab.held, vocab.weight, vocab.lengths

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UrlModel(counts, weight, lengths)
        for batch in batches:
            hosts, paths, ruled, others = (batch.column(c).to_pylist() for c in ("host", "path", "ruled", "others"))
            words = [model.words(h, p, [(o["w"], o["n"]) for o in some or ()]) for h, p, some in zip(hosts, paths, others, strict=True)]
            odds = [model.bayes.odds(w) for w in words]
            verdicts = [r or ("block" if o > threshold else "allow") for r, o in zip(ruled, odds, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array([" ".join(w) for w in words], pa.string()), pa.array(odds, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "words", "odds"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, words string, odds double")
