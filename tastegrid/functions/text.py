"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tastegrid.functions.words import REVIEW_STOPWORDS

TOKEN = "[a-zA-Z][a-zA-Z0-9_-]{2,}"


def terms(text: Column) -> Column:
    """Tokens of at least three characters that begin with a letter, lower-cased; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def without(tokens: Column, words: list[str]) -> Column:
    """Tokens that are not in ``words``; repeats and order stay."""
    return F.filter(tokens, lambda t: ~t.isin(words))


def join_parts(*parts: Column) -> Column:
    """Non-null parts with a blank between."""
    return F.concat_ws(" ", *parts)


def map_text(column: Column, keys: bool = True) -> Column:
    """Entries of a map as words: ``key value`` pairs, or the values alone."""
    if keys:
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    return F.array_join(F.map_values(column), " ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for an array result, with ``value`` evaluated once per row however often ``use`` names it.

    Spark does not share subexpressions inside higher-order functions; a lambda variable is bound once.
    """
    return F.flatten(F.transform(F.array(value), use))


def review_terms(text: Column) -> Column:
    """Unigrams without stop words, then bigrams ``a_b`` of unequal neighbours; units are joined to their number."""
    joined = F.regexp_replace(F.lower(text), r"(\d+)\s*(oz|ml|inch|inches|count|pack)", "$1_$2")

    def with_pairs(base: Column) -> Column:
        n = F.greatest(F.size(base) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(base, 1, n), F.slice(base, 2, n), lambda a, b: F.when(a != b, F.concat(a, F.lit("_"), b)))
        return F.concat(base, F.array_compact(pairs))

    return once(without(terms(joined), REVIEW_STOPWORDS), with_pairs)


def one_spelling(value: Column) -> Column:
    """Lower case, trimmed, runs of blanks and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_")


def hashed_slot(term: Column, size: int = 64) -> Column:
    """Slot of a term: the first four bytes of its SHA-256, big-endian, modulo ``size``."""
    return (F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long") % size).cast("int")


def hashed_sign(term: Column) -> Column:
    """+1 for an even fifth byte of the SHA-256, else -1."""
    return F.when(F.conv(F.substring(F.sha2(term, 256), 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two number arrays; 0 where lengths differ or one is empty or null."""
    product = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(left) == F.size(right)) & (F.size(left) > 0), product).otherwise(0.0)


def overlap(left: Column, right: Column) -> Column:
    """Share of the entries of ``left``, with repeats, that are in ``right``; 0 where either is empty."""
    hits = F.size(F.filter(left, lambda t: F.array_contains(right, t)))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), hits / F.size(left)).otherwise(0.0)
