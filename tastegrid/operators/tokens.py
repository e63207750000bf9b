"""Words of texts counted inside the task.

Exploded words are many times the texts, and each would be hashed or sorted as a row of its own. Here rows arrive gathered and sorted
by their key, so the words of a key are counted in one dictionary and only its counts, or the best of them, leave the task. The words
are those of ``functions.text``.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from tastegrid.operators.scoring import round_half_up

_TOKEN = re.compile("[a-zA-Z][a-zA-Z0-9_-]{2,}")
_UNIT = re.compile(r"([0-9]+)[ \t\n\x0b\f\r]*(oz|ml|inch|inches|count|pack)")
#: Rows of an output batch.
_BATCH = 50_000

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def terms(text: str, without: frozenset[str] = frozenset()) -> list[str]:
    return [w for w in _TOKEN.findall(text.lower()) if w not in without]


def review_terms(text: str, without: frozenset[str]) -> list[str]:
    base = [w for w in _TOKEN.findall(_UNIT.sub(r"\1_\2", text.lower())) if w not in without]
    return base + [f"{a}_{b}" for a, b in zip(base, base[1:]) if a != b]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def best_words(most: int, without: Iterable[str]) -> Kernel:
    """(user_id, mood, term, n, rank): the ``most`` frequent words of each mood of ``(user_id, mood, text)``, ties by word."""
    stop = frozenset(without)

    def best(user: str, counts: dict[str, Counter]) -> Iterator[tuple]:
        for mood, count in counts.items():
            for rank, (term, n) in enumerate(heapq.nsmallest(most, count.items(), key=lambda x: (-x[1], x[0])), 1):
                yield user, mood, term, n, rank

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, counts = None, {}
        for user, mood, text in _keyed(batches):
            if user != last:
                yield from best(last, counts)
                last, counts = user, {}
            counts.setdefault(mood, Counter()).update(terms(text, stop))
        yield from best(last, counts)

    return lambda batches: _batches(rows(batches), ("user_id", "mood", "term", "n", "rank"), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()))


def summed_words(without: Iterable[str]) -> Kernel:
    """(item_id, term, tf): sums of the weights of the review words of ``(item_id, w, text)``."""
    stop = frozenset(without)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, sums = None, {}
        for item, w, text in _keyed(batches):
            if item != last:
                yield from ((last, t, v) for t, v in sums.items())
                last, sums = item, {}
            for t in review_terms(text, stop):
                sums[t] = sums.get(t, 0.0) + w
        yield from ((last, t, v) for t, v in sums.items())

    return lambda batches: _batches(rows(batches), ("item_id", "term", "tf"), (pa.string(), pa.string(), pa.float64()))


def heaviest_words(most: int, without: Iterable[str]) -> Kernel:
    """(user_id, term, w): the ``most`` words with the greatest sums, of the review words of ``(user_id, w, text, words, values)`` with w and of
    its ``words`` with w times ``values``; ties by word."""
    stop = frozenset(without)

    def best(user: str, sums: dict[str, float]) -> Iterator[tuple]:
        if sums:
            rounded = zip(sums, round_half_up(np.fromiter(sums.values(), float), 9).tolist())
            for term, w in heapq.nsmallest(most, rounded, key=lambda x: (-x[1], x[0])):
                yield user, term, w

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, sums = None, {}
        for user, w, text, words, values in _keyed(batches):
            if user != last:
                yield from best(last, sums)
                last, sums = user, {}
            for t in review_terms(text, stop) if text is not None else ():
                sums[t] = sums.get(t, 0.0) + w
            for t, v in zip(words, values):
                sums[t] = sums.get(t, 0.0) + w * v
        yield from best(last, sums)

    return lambda batches: _batches(rows(batches), ("user_id", "term", "w"), (pa.string(), pa.string(), pa.float64()))
