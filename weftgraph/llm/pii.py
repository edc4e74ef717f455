"""Surrogates for personal data.

Entities (e-mail addresses, telephone, card and account numbers, network addresses, secrets, names after a title) are found
in whole texts. Each distinct value gets one surrogate, made by a key: of the same type and format (length, separators,
case, country code, checksum), and for names of the same gender and script. A value's surrogate is the same wherever it
stands, in whatever format (coreference); given and family names are values of their own, so that a later mention by family
name still fits, and a given name has one surrogate whatever title it follows. Names found after a title are replaced at
their untitled mentions in the same text too, where they begin with no small letter. Digits of any script are digits, and
keep their script. Surrogates are checked over the whole corpus: where two values of a type would share one, or one would
be a value that stands in the corpus, all but the first are made again from another draw until none is left
(distinctness); when the space of a format is used up, surrogates get longer.

Only rows with entities meet the table of surrogates, by value; all other rows pass through without a shuffle.

Defined cases: null and empty texts stay as they are; repeated rows and values are replaced alike; null ids need nothing; an
empty table gives an empty result; other columns pass through, n_chars is counted again where there is one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import kept

#: Key of tests and synthetic data only, as anyone can read it; real data take theirs from the session's setting.
PUBLIC_KEY = b"weft-surrogates"
KEY_SETTING = "spark.weftgraph.surrogate.key"
#: Title: gender. Names follow titles.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Dr": "u", "Prof": "u", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carl Daniel David Emil Erik Felix Frank Georg Henry Hugo Ivan Jacob James Jonas Julian Karl Leo Louis Lucas Marco Martin Max Noah Oscar Paul Peter Robert Samuel Simon Theo Thomas Victor Walter".split(),
    ("latin", "f"): "Ada Alice Amelia Anna Beatrice Carla Clara Diana Elena Emma Eva Flora Greta Hanna Helen Ida Irene Isabel Jana Julia Laura Lea Lena Lucia Maria Marta Mia Nina Nora Olivia Paula Rosa Sara Sofia Stella Vera".split(),
    ("latin", "u"): "Alex Andrea Ariel Charlie Dominique Eden Jamie Jean Jordan Kim Lou Morgan Noa Robin Sam Sascha Sidney Toni".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Софья Татьяна".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
    ("greek", "f"): "Άννα Ειρήνη Ελένη Ζωή Μαρία Σοφία".split(),
}
#: Syllables of family names by script.
SYLLABLES = {"latin": "ba ber da del el en fal gar hal in ka ker la len mar mon na nor ol per ra ren sa son ta tor ul va ver wen".split(), "cyrillic": "ба ва га де жи ко ла ми но пе ро са ту фе ха це".split(), "greek": "βα γε δα κο λα μι νο πε ρο σα τυ φι χα ζω".split()}

_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:['’-][^\W\d_]+)?"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<secret>(?<!\w)(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128}(?!\w))"
    r"|(?P<access>(?<!\w)A[KS]IA[A-Z0-9]{16}(?!\w))"
    r"|(?P<password>(?i:(?<=password=)|(?<=passwd=)|(?<=api_key=)|(?<=secret=))[^\s\"'&,;|<>]{4,128})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,5}){1,3}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
    rf"|(?P<name>(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s(?:{_NAME}\s)?{_NAME})"
)
_MAYBE = re.compile(rf"[@\d=]|(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s")
_MENTION = re.compile(rf"(?<!\w){_NAME}(?!\w)")


def script(text: str) -> str:
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "")
            return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"
    return "latin"


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def ascii_digits(text: str) -> str:
    return text if text.isascii() else "".join(str(unicodedata.decimal(c, c)) for c in text)


def values(match: re.Match) -> list[tuple[str, str, int, int]]:
    """Type, canonical value, start and end of each value of a match."""
    kind = match.lastgroup if match.lastgroup != "title" else "name"
    text, start = match[0], match.start()
    if kind != "name":
        text = text if kind == "password" else ascii_digits(text)
        canon = text.lower() if kind in ("email", "secret") else re.sub(r"[^0-9A-Za-z]", "", text).upper() if kind in ("iban", "card", "ssn", "phone") else text
        return [(kind, canon, start, match.end())]
    words = [(m[0], start + m.start(), start + m.end()) for m in re.finditer(r"\S+", text)][1:]
    gender = TITLES[match["title"]]
    out = [(f"given_{gender}", w.casefold(), a, b) for w, a, b in words[:-1]]
    return [*out, ("family", words[-1][0].casefold(), words[-1][1], words[-1][2])]


def found(text: str | None) -> list[tuple[str, str, int, int]]:
    if not text or not _MAYBE.search(text):
        return []
    titled = [v for m in PATTERN.finditer(text) for v in values(m)]
    names: dict[str, str] = {}
    for kind, value, _, _ in titled:
        if kind == "family" or kind.startswith("given_"):
            names[value] = "family" if "family" in (kind, names.get(value)) else names.get(value, kind)
    return sorted(titled + untitled(text, names, titled), key=lambda v: v[2]) if names else titled


def untitled(text: str, names: dict[str, str], titled: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """Mentions of the names outside of what has been found: whole, or as parts of compounds."""
    out, k = [], 0
    for m in _MENTION.finditer(text):
        for w in [m] if m[0].casefold() in names else re.compile(r"[^\W\d_]+").finditer(text, m.start(), m.end()):
            while k < len(titled) and titled[k][3] <= w.start():
                k += 1
            if (name := w[0].casefold()) in names and not w[0][0].islower() and (k == len(titled) or w.end() <= titled[k][2]):
                out.append((names[name], name, w.start(), w.end()))
    return out


class _Draw:
    """A stream of numbers from the key, a type, a value and an attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed, self.block, self.n = f"{kind}\0{value}\0{attempt}".encode("utf-8", "replace"), b"", 0
        self.key = key

    def below(self, most: int) -> int:
        if len(self.block) < 4:
            self.block += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        out, self.block = int.from_bytes(self.block[:4], "big") % most, self.block[4:]
        return out


#: What signs are drawn from where a password has nothing else.
SIGNS = "!#$%()*+-./:?@[]^_{}~"


def surrogate(kind: str, value: str, attempt: int, key: bytes = PUBLIC_KEY, longer: int = 0) -> str:
    """The canonical surrogate of a canonical value. longer: by so many characters, syllables or numbers."""
    draw = _Draw(key, kind, value, attempt)
    digit = lambda: str(draw.below(10))
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4 + longer))
    if kind.startswith("given_") or kind == "family":
        way = script(value)
        pool = GIVEN.get((way, kind[-1])) or GIVEN[(way, "m")] if kind != "family" else None
        if pool and attempt < 3:
            return pool[draw.below(len(pool))].casefold()
        parts = SYLLABLES[way]
        ending = {"latin": {"f": "a", "m": "o"}, "cyrillic": {"f": "а", "m": "ий"}, "greek": {"f": "α", "m": "ος"}}[way].get(kind[-1], "") if pool else ""
        return "".join(parts[draw.below(len(parts))] for _ in range(2 + min(attempt // 2, 6) + longer)) + ending
    if kind == "email":
        local, _, domain = value.partition("@")
        name, _, top = domain.rpartition(".")
        swap = lambda s: "".join(letters[draw.below(26)] if c.isalpha() else digit() if c.isdigit() else c for c in s)
        return f"{swap(local + 'x' * longer)}@{swap(name)}.{top}"
    if kind in ("access", "password"):
        signs = not any(c.isalnum() for c in value)
        new = lambda c: digit() if c.isnumeric() else chr(65 + draw.below(26)) if c.isupper() else chr(97 + draw.below(26)) if c.isalpha() else SIGNS[draw.below(len(SIGNS))] if signs else c
        keep = 4 if kind == "access" else 0
        return value[:keep] + "".join(map(new, value[keep:] + ("X" if kind == "access" else "x") * longer))
    if kind == "secret":
        while True:
            out = "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(value) + longer))
            if any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
                return out
    if kind == "iban":
        body = "".join(digit() if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(26)] for c in value[4:] + "0" * longer)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "card":
        out = value[0] + "".join(digit() for _ in range(len(value) - 2 + longer))
        last = next(d for d in "0123456789" if luhn(out + d))
        return out + (last if luhn(value) else str((int(last) + 1 + draw.below(9)) % 10))
    keep = 1 if kind == "phone" and len(value) > 10 else 0  # the country code's first digit
    return value[:keep] + "".join(str(1 + draw.below(9)) if k == keep else digit() for k in range(keep, len(value) + longer))


def formatted(kind: str, surface: str, new: str) -> str:
    """The canonical surrogate in the format of what it replaces."""
    if kind in ("iban", "card", "ssn", "phone"):
        rest = iter(new)
        return "".join((chr(ord(c) - unicodedata.decimal(c) + int(next(rest))) if c.isdecimal() and not c.isascii() else next(rest)) if c.isalnum() else c for c in surface) + "".join(rest)
    if kind in ("ip", "access", "password"):
        return new
    if kind == "family" or kind.startswith("given_"):
        return new.upper() if surface.isupper() and len(surface) > 1 else new.title() if surface[:1].isupper() else new
    upper = [c.isupper() for c in surface]
    if len(new) == len(surface):
        letters = [c for c in surface if c.isalpha()]
        if kind == "secret":
            return new.upper() if letters and all(c.isupper() for c in letters) else new
        return "".join(c.upper() if u else c for c, u in zip(new, upper, strict=True))
    return new


def surrogate_table(entities: DataFrame, key: bytes = PUBLIC_KEY, most: int = 40) -> DataFrame:
    """kind, value and surrogate: distinct within a kind, and none a value of the corpus. Losers of a collision draw again, after most draws longer ones each time."""
    entities = kept(entities.select("kind", "value"), "entities")

    def make(attempt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, names = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
                yield pa.record_batch([batch.column("kind"), batch.column("value"), pa.array([surrogate(k, v, attempt, key, max(0, attempt + 1 - most)) for k, v in zip(kinds, names, strict=True)], pa.string())], ["kind", "value", "surrogate"])

        return run

    done, open_ = None, entities
    # all names are of one space of spellings: a surrogate of one kind must not be a name of another
    space = lambda c: F.when(F.col(c).startswith("given_") | (F.col(c) == "family"), "name").otherwise(F.col(c))
    taken = entities.select(space("kind").alias("space"), F.col("value").alias("surrogate"))
    for attempt in count():
        drawn = open_.mapInArrow(make(attempt), "kind string, value string, surrogate string").withColumn("space", space("kind"))
        # a spelling that several draw goes to the one of the smallest hash; aggregated before the shuffle
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct(F.xxhash64("kind", "value").alias("h"), "kind", "value")).alias("w"))
        won = kept(first.join(taken, ["space", "surrogate"], "left_anti").select("w.kind", "w.value", "surrogate", "space"), "surrogates")
        done = won if done is None else done.unionByName(won)
        open_ = kept(open_.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "open")
        if open_.isEmpty():
            return done.select("kind", "value", "surrogate")
        taken = taken.unionByName(won.select("space", "surrogate"))


def session_key(spark: SparkSession) -> bytes:
    """The key that the session sets, or the public one, which hides nothing from who knows this code."""
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY.decode()).encode()


def same_names(pairs: DataFrame) -> DataFrame:
    """kind, value and name: the kind that a value is drawn as. A given name has one surrogate whatever titles it stands after: of the gender that all titles that tell one agree on."""
    given = F.col("kind").startswith("given_")
    told = pairs.groupBy(F.when(given, F.lit("given")).otherwise(F.col("kind")).alias("kind"), "value").agg(F.max(F.col("kind") == "given_m").alias("m"), F.max(F.col("kind") == "given_f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "given_m").when(F.col("f") & ~F.col("m"), "given_f").otherwise("given_u")
    return told.select("kind", "value", F.when(F.col("kind") == "given", gender).otherwise(F.col("kind")).alias("drawn"))


def replace_entities(docs: DataFrame, key: bytes = PUBLIC_KEY, counted: str = "n_entities") -> DataFrame:
    """The rows of docs with surrogates in text, and a last column, named by counted, with the number of values replaced in each; a column of docs of that name is kept as it is, and the last one is then ``_`` and the name."""
    columns = docs.columns
    while counted in columns:
        counted = f"_{counted}"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({(k, v) for k, v, _, _ in found(t)}) for t in pc.struct_field(batch.column("_row"), "text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([[{"kind": k, "value": v} for k, v in x] for x in own], kind)], ["_row", "_found"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    pairs = ArrayType(StructType().add("kind", "string").add("value", "string"))
    marked = packed.mapInArrow(mark, StructType([*packed.schema, StructField("_found", pairs)]))
    hits = kept(marked.filter(F.size("_found") > 0).withColumn("_at", F.monotonically_increasing_id()), "hits")
    met = hits.select("_at", F.explode("_found").alias("f")).select("_at", "f.kind", "f.value")
    names = kept(same_names(met), "names")
    table = surrogate_table(names.select(F.col("drawn").alias("kind"), "value"), key).withColumnRenamed("kind", "drawn")
    table = names.join(table, ["drawn", "value"]).select("kind", "value", "surrogate")
    # a value that many rows hold meets its surrogate in many tasks; the number of values of one row is that of its text
    met = met.withColumn("kind", F.when(F.col("kind").startswith("given_"), "given").otherwise(F.col("kind"))).distinct().join(table, ["kind", "value"])
    maps = met.groupBy("_at").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("_map"))

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], []
            for text, pairs in zip(pc.struct_field(batch.column("_row"), "text").to_pylist(), batch.column("_map").to_pylist(), strict=True):
                new, out, at, n = {(p["kind"], p["value"]): p["surrogate"] for p in pairs}, [], 0, 0
                for kind, value, start, end in found(text):
                    out += [text[at:start], formatted(kind, text[start:end], new["given" if kind.startswith("given_") else kind, value])]
                    at, n = end, n + 1
                texts.append("".join(out) + text[at:])
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(numbers, pa.int64())], ["_row", "_text", "n_entities"])

    swapped = hits.join(maps, "_at").select("_row", "_map").mapInArrow(swap, StructType([*packed.schema, StructField("_text", StringType()), StructField("n_entities", LongType())]))
    rest = marked.filter(F.size("_found") == 0).select("_row", F.col("_row.text").alias("_text"), F.lit(0).cast("long").alias("n_entities"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("_text").alias("text")
        if c == "n_chars":
            return F.when(F.col("n_entities") > 0, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"_row.`{c}`").alias(c)

    return rest.unionByName(swapped).select(*map(column, columns), F.col("n_entities").alias(counted))
