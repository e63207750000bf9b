"""Visually identical text: look-alike classes by union-find, representatives, greedy rewriting.

The characters in use are counted over the whole collection. Rules say which of them, and which strings of
a base and a combining mark, look alike: full-width forms, kinds of blank, characters without width, letters of
other scripts drawn like Latin ones, composed and combining accents. Union-find makes the rules transitive; each
class is written as its most frequent single character. An Aho-Corasick automaton rewrites texts by the longest
match from the left, until nothing changes; canonical composition (NFC) orders and joins remaining marks.

Case, accents, letters and digits that look different stay different; line breaks and tabs are kept.

Defined results: null stays null; an empty text stays empty; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.plans.scratch import cut, ship_package

# Letters of other scripts and the Latin letters they are drawn like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "ү": "y",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin letters drawn like the basic ones
    "ɡ": "g", "ɑ": "a", "ı": "i",
}
# Characters without width beside the format characters (category Cf).
WIDTHLESS = ["͏", "ᅟ", "ᅠ", "឴", "឵", "᠋", "᠌", "᠍", "ㅤ", "ﾠ"]


class UnionFind:
    """Disjoint sets of strings with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _is_widthless(c: str) -> bool:
    return c in WIDTHLESS or unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF


def _single(c: str) -> str:
    """What one character is drawn like by the rules alone."""
    if 0xFF01 <= ord(c) <= 0xFF5E:
        return chr(ord(c) - 0xFEE0)
    if unicodedata.category(c) == "Zs":
        return " "
    if _is_widthless(c):
        return ""
    return LOOKALIKES.get(c, c)


@functools.cache
def rule_characters() -> frozenset[str]:
    """Every character the rules speak of: full-width forms, blanks, characters without width, look-alike letters, and
    composed letters whose base is a look-alike."""
    found = set(LOOKALIKES) | set(LOOKALIKES.values()) | {chr(i) for i in range(0xFF01, 0xFF5F)} | set(WIDTHLESS)
    for i in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE01F0)):
        c = chr(i)
        if unicodedata.category(c) in ("Zs", "Cf") or _is_widthless(c):
            found.add(c)
        elif (parts := unicodedata.normalize("NFD", c)) != c and parts[0] in LOOKALIKES:
            found.add(c)
            found.update(parts[1:])
    return frozenset(found)


def rewriting(counts: dict[str, int]) -> dict[str, str]:
    """Pattern -> representative over the characters with their counts in the collection."""
    used = set(counts) | rule_characters()
    sets = UnionFind()
    marks = [c for c in used if unicodedata.combining(c)]
    for c in used:
        sets.union(c, _single(c))
        # composed letters: their parts, and what the parts are drawn like
        parts = unicodedata.normalize("NFD", c)
        if parts != c:
            drawn = unicodedata.normalize("NFC", "".join(map(_single, parts)))
            sets.union(c, parts)
            sets.union(c, drawn)
            sets.union(parts, "".join(map(_single, parts)))
    for base in used:
        if (drawn := _single(base)) == base or not drawn.isalpha():
            continue
        for mark in marks:
            joined = unicodedata.normalize("NFC", drawn + mark)
            sets.union(base + mark, drawn + mark)
            sets.union(drawn + mark, joined)
            whole = unicodedata.normalize("NFC", base + mark)
            if len(whole) == 1:
                sets.union(whole, base + mark)
    out: dict[str, str] = {}
    for members in sets.classes():
        if "" in members:
            best = ""
        else:
            single = [m for m in members if len(m) == 1] or members
            best = min(single, key=lambda m: (-counts.get(m, 0), not m.isascii(), m))
        out.update((m, best) for m in members if m != best and m)
    return out


class Rewriter:
    """Greedy longest-match rewriting to a fixed point; plain ASCII passes untouched where no rule changes ASCII."""

    def __init__(self, patterns: dict[str, str]) -> None:
        self.patterns = patterns
        self.ascii_fixed = all(not p.isascii() for p in patterns)
        # every pattern holds one of these: itself, or the mark that ends it
        self.triggers = "".join(sorted({p[-1] for p in patterns}))
        self._automaton = self._trigger = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_trigger": None}

    def _once(self, text: str) -> str:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for p, r in self.patterns.items():
                self._automaton.add_word(p, (len(p), r))
            self._automaton.make_automaton()
        out, at = [], 0
        for end, (length, new) in self._automaton.iter_long(text):
            begin = end + 1 - length
            out.append(text[at:begin])
            out.append(new)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.ascii_fixed and text.isascii():
            return text
        text = unicodedata.normalize("NFC", text)
        if not self.patterns:
            return text
        if self._trigger is None:
            self._trigger = re.compile(f"[{re.escape(self.triggers)}]")
        seen = {text}
        while self._trigger.search(text):
            text = unicodedata.normalize("NFC", self._once(text))
            if text in seen:
                break
            seen.add(text)
        return text


def character_counts(df: DataFrame, text_col: str) -> dict[str, int]:
    """Occurrences of every character in use; at most as many entries as Unicode has characters."""
    ship_package(df.sparkSession)
    rows = df.select(text_col).mapInArrow(_all_counts, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return {r["c"]: r["n"] for r in rows}


def _all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for i in range(0, len(texts), 256):
            codes = np.frombuffer("".join(texts[i : i + 256]).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.bincount(codes)
            total[: len(n)] += n
    total[0xD800:0xE000] = 0
    used = np.flatnonzero(total)
    if len(used):
        yield pa.record_batch([pa.array([chr(c) for c in used]), pa.array(total[used])], names=["c", "n"])


def _rewrite_mapper(rewriter: Rewriter) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else rewriter(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(new, pa.string())], names=[*batch.schema.names[:-1], "canonical"])

    return run


def canonical(df: DataFrame, id_col: str, text_col: str, rewriter: Rewriter | None = None) -> DataFrame:
    """(id_col, canonical): every text in its one form, over the classes of the whole table."""
    rewriter = rewriter or Rewriter(rewriting(character_counts(df, text_col)))
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_rewrite_mapper(rewriter), f"`{id_col}` {kind}, canonical string")


def _hash_mapper(rewriter: Rewriter) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, one, raw = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t is not None and (new := rewriter(t)).strip():
                    rows.append(i)
                    one.append(blake2b(new.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    raw.append(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(one, pa.binary()), pa.array(raw, pa.binary())], names=["id", "one", "raw"])

    return run


def lookalike_classes(df: DataFrame, id_col: str, text_col: str, rewriter: Rewriter | None = None) -> DataFrame:
    """(id, one, raw): hash of the one form and of the stored text, for ids whose form has several stored texts."""
    ship_package(df.sparkSession)
    rewriter = rewriter or Rewriter(rewriting(character_counts(df, text_col)))
    kind = df.schema[id_col].dataType.simpleString()
    rows = cut(df.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(_hash_mapper(rewriter), f"id {kind}, one binary, raw binary"))
    several = rows.groupBy("one", "raw").agg(F.count("*").alias("n")).groupBy("one").agg(F.count("*").alias("forms")).where("forms > 1").select("one")
    return rows.join(several, "one", "left_semi").distinct()


def lookalike_groups(df: DataFrame, id_col: str, text_col: str, rewriter: Rewriter | None = None) -> DataFrame:
    """(id, class_id, n_forms): rows whose one form has several stored texts, the least id of their class and the number of those texts.

    One row per record; nothing is paired, so classes of any size are handled.
    """
    rows = cut(lookalike_classes(df, id_col, text_col, rewriter))
    named = rows.groupBy("one", "raw").agg(F.min("id").alias("id")).groupBy("one").agg(F.min("id").alias("class_id"), F.count("*").alias("n_forms"))
    return rows.join(named, "one").select("id", "class_id", "n_forms").distinct()


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, rewriter: Rewriter | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of the same one form whose stored texts differ.

    Stored texts are paired first, then expanded to their rows, so equal copies are never paired with each other.
    """
    rows = cut(lookalike_classes(df, id_col, text_col, rewriter))
    forms = rows.select("one", "raw").distinct()
    both = forms.toDF("one", "raw_x").join(forms.toDF("one", "raw_y"), "one").where("raw_x < raw_y").select("raw_x", "raw_y")
    x, y = rows.select(F.col("raw").alias("raw_x"), F.col("id").alias("x")), rows.select(F.col("raw").alias("raw_y"), F.col("id").alias("y"))
    return both.join(x, "raw_x").join(y, "raw_y").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
