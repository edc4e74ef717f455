"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import KEYWORD_STOPWORDS, STOPWORDS, WORD_CAP


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens of two or more characters that begin with a letter, stop words dropped, repeats kept. Non-ASCII letters and digits bind like letters but begin no token."""
    marked = F.regexp_replace(F.lower(text), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "X")
    found = F.regexp_extract_all(marked, F.lit(r"\b[a-z][a-z0-9_-]+\b"), 0)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def long_tokens(text: Column) -> Column:
    """Tokens of three or more characters that aren't among the longer list of stop words, repeats kept."""
    marked = F.regexp_replace(F.lower(text), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "X")
    found = F.regexp_extract_all(marked, F.lit(r"\b[a-z][a-z0-9_-]+\b"), 0)
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*KEYWORD_STOPWORDS))


def plain_words(text: Column) -> Column:
    """Lower-case runs of three or more ASCII letters, no stop words."""
    marked = F.regexp_replace(F.lower(text), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "X")
    return F.regexp_extract_all(marked, F.lit(r"\b[a-z]{3,}\b"), 0)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def truncated(text: Column, most: int = WORD_CAP) -> Column:
    """The text itself if it has at most so many words, else its first words joined by blanks."""
    # the split ends where it is known whether there are more words, whatever the text's length
    first = F.filter(F.split(text, r"(?U)\s+", most + 3), lambda w: w != "")
    return F.when(F.size(first) <= most, text).otherwise(F.array_join(F.slice(first, 1, most), " "))


def slug(name: Column, prefix: str = "entity:") -> Column:
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("."), F.lit("")), "[^a-z0-9]+", "-")
    return F.concat(F.lit(prefix), F.regexp_replace(plain, "^-+|-+$", ""))


def category(chunk_id: Column) -> Column:
    return F.split_part(chunk_id, F.lit(":"), F.lit(1))


def is_chunk_id(chunk_id: Column) -> Column:
    return chunk_id.rlike("^[a-z]+:[a-z0-9-]+$")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays read as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def iso_day(text: Column, default: str = "2025-01-01") -> Column:
    return F.substring(F.coalesce(text, F.lit(default)), 1, 10)


def injected_context(text: Column, context: Column) -> Column:
    """The text's tagged spans with a context comment at their head."""
    pattern = r"(?is)<Chunk\s+id=[\"']([^\"']+)[\"']>\s*(.*?)\s*</Chunk>"
    return F.regexp_replace(text, F.lit(pattern), F.concat(F.lit('<Chunk id="$1">\n<!-- Context: '), context, F.lit(" -->\n\n$2\n</Chunk>")))
