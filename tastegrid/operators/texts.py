"""Small text and list rules as Column expressions: matches, sentiment, clean values, labelled lines, merged lists.

Defined results: null texts count as empty; an empty list matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that make a text sound positive or negative.
POSITIVE = ("excellent", "perfect", "great", "good", "useful", "helpful", "love", "fits")
NEGATIVE = ("terrible", "awful", "bad", "poor", "hate", "misses", "cautious", "disappointing")


def matched_terms(left: Column, right: Column, most: int = 5) -> Column:
    """First ``most`` distinct entries of ``left`` that are in ``right``, in the order of ``left``."""
    return F.slice(F.filter(F.array_distinct(left), lambda t: F.array_contains(right, t)), 1, most)


def merged_terms(*groups: Column, most: int = 8) -> Column:
    """First ``most`` distinct entries of the lists one after the other."""
    return F.slice(F.array_distinct(F.concat(*groups)), 1, most)


def sentiment_aligned(stars: Column, text: Column) -> Column:
    """Whether a text's tone fits its stars: from 4 up positive or at least not negative, up to 2 the reverse, else always."""
    lowered = F.coalesce(F.lower(text), F.lit(""))
    positive, negative = (lowered.rlike("|".join(words)) for words in (POSITIVE, NEGATIVE))
    return F.when(stars >= 4, positive | ~negative).when(stars <= 2, negative | ~positive).otherwise(F.lit(True))


def clean_token(value: Column) -> Column:
    """Lower case, only a-z, 0-9, blank, hyphen and underscore, blanks as underscores; empty unless 3 to 32 characters long."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9_ -]", ""), r"\s+", "_")
    return F.when(F.length(kept).between(3, 32), kept).otherwise("")


def clean_phrase(value: Column, most: int = 160) -> Column:
    """Trimmed, runs of blanks as one, at most ``most`` characters (the length is the rule's own)."""
    return F.substring(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " "), 1, most)


def line_value(text: Column, label: str) -> Column:
    """Trimmed rest of the first line ``label: ...``; empty without one. ``label`` is taken as letters and digits."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?m)^{label}:\s*(.+)$", 1))


def variant(seed: Column, stars: Column, n: int = 3) -> Column:
    """(sum of the seed's code points + stars) modulo ``n``."""
    return (F.aggregate(F.transform(F.split(seed, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) + stars.cast("long")) % n
