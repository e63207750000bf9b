"""Test passages leaking into documents: winnowed fingerprints, joined and extended.

Both sides are brought to one form, lower-cased and cut into words. Of each window of WINDOW consecutive hashes
of K words the least is kept (the last on ties), so any shared run of K + WINDOW - 1 words shares a fingerprint.
Fingerprint hits are extended to both sides, word by word; runs of at least ``span`` words are reported.

The test side is checked for size: up to MAX_TEST_WORDS words its fingerprints travel to the document tasks and
nothing is shuffled; above that both sides' fingerprints are joined by the cluster and hits are extended after it.

Defined results: null texts and texts shorter than ``span`` words hold nothing; repeated ids count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.llm import kernel as K
from tastegrid.llm.lookalike import Rewriter, rewriting
from tastegrid.plans.scratch import cut, ship_package

#: Words of the test side that are sent to every task at most: 32 MB of hashes.
MAX_TEST_WORDS = 4_000_000


def _split(span: int) -> tuple[int, int]:
    """(words per gram, grams per window) with gram + window - 1 = span."""
    k = (span + 1) // 2
    return k, span - k + 1


def _words(texts: list[str | None], rewriter: Rewriter) -> K.Words:
    return K.letter_words([None if t is None else rewriter(t).lower() for t in texts])


def winnow(words: K.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, word position) of the least gram hash of every window; the last one on ties."""
    value, doc, position = K.grams(words, k)
    if len(value) < window:
        return value[:0], doc[:0], position[:0]
    view = np.lib.stride_tricks.sliding_window_view(value, window)
    inside = np.flatnonzero(doc[: len(view)] == doc[window - 1 :])
    at = np.unique(inside + window - 1 - np.argmin(view[inside][:, ::-1], axis=1))
    return value[at], doc[at], position[at]


def _run_length(a: np.ndarray, i: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray, j: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray, k: int, span: int) -> np.ndarray:
    """Length of the common run around equal grams at i and j, counted up to ``span`` words on either side."""
    total = np.full(len(i), k)
    for sign, first in ((-1, -1), (1, k)):
        alive = np.ones(len(i), bool)
        for step in range(span):
            x, y = i + first + sign * step, j + first + sign * step
            alive &= (x >= a_lo) & (x < a_hi) & (y >= b_lo) & (y < b_hi)
            if not alive.any():
                break
            alive[alive] = a[x[alive]] == b[y[alive]]
            total += alive
    # the gram itself is checked word by word too
    same = np.ones(len(i), bool)
    for step in range(k):
        same &= a[i + step] == b[j + step]
    return np.where(same, total, 0)


def _probe(test: dict, rewriter: Rewriter, k: int, window: int, span: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in K.slices(batch.column(1)):
                words = _words(texts, rewriter)
                value, doc, position = winnow(words, k, window)
                lo, hi = np.searchsorted(test["fp"], value, "left"), np.searchsorted(test["fp"], value, "right")
                times = hi - lo
                if not times.sum():
                    continue
                hit = np.repeat(np.arange(len(value)), times)
                entry = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(len(hit))
                d, p = doc[hit], test["fp_doc"][entry]
                length = _run_length(words.hash, words.start[d] + position[hit], words.start[d], words.start[d] + words.count[d], test["words"], test["start"][p] + test["fp_pos"][entry], test["start"][p], test["start"][p] + test["count"][p], k, span)
                long = length >= span
                if not long.any():
                    continue
                d, p, length = d[long], p[long], length[long]
                key = d * len(test["ids"]) + p
                order = np.lexsort((-length, key))
                first = order[np.concatenate(([True], np.diff(key[order]) > 0))]
                ids = batch.column(0).take(pa.array(d[first] + begin))
                yield pa.record_batch([ids, pa.array(test["ids"][p[first]])], names=["doc_id", "passage_id"])

    return run


def _fingerprinter(rewriter: Rewriter, k: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in K.slices(batch.column(1)):
                value, doc, _ = winnow(_words(texts, rewriter), k, window)
                yield pa.record_batch([batch.column(0).take(pa.array(doc + begin)), pa.array(value.view(np.int64))], names=["id", "fp"])

    return run


def _extender(rewriter: Rewriter, k: int, window: int, span: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _words(batch.column(1).to_pylist(), rewriter), _words(batch.column(3).to_pylist(), rewriter)
            keep = []
            for i in range(batch.num_rows):
                ga = set(K.grams(K.Words(a.of(i), np.zeros(a.count[i], np.int64), 1), span)[0].tolist())
                gb = K.grams(K.Words(b.of(i), np.zeros(b.count[i], np.int64), 1), span)[0].tolist()
                if not ga.isdisjoint(gb):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at)], names=["doc_id", "passage_id"])

    return run


def leaks(documents: DataFrame, doc_id: str, doc_text: str, passages: DataFrame, passage_id: str, passage_text: str, *, span: int = 13, rewriter: Rewriter | None = None, max_test_words: int = MAX_TEST_WORDS) -> DataFrame:
    """(doc_id, passage_id): documents that hold at least ``span`` consecutive words of a passage."""
    spark = documents.sparkSession
    ship_package(spark)
    rewriter = rewriter or Rewriter(rewriting({}))
    k, window = _split(span)
    d_type, p_type = documents.schema[doc_id].dataType.simpleString(), passages.schema[passage_id].dataType.simpleString()
    docs = documents.select(doc_id, doc_text).where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull())
    tests = passages.select(passage_id, passage_text).where(F.col(passage_id).isNotNull() & F.col(passage_text).isNotNull())
    # words are at least one character and one blank long
    size = tests.agg(F.sum((F.length(passage_text) + 1) / 2)).first()[0] or 0
    if size <= max_test_words:
        table = tests.toArrow()
        words = _words(table.column(1).to_pylist(), rewriter)
        value, doc, position = winnow(words, k, window)
        order = np.argsort(value, kind="stable")
        test = {"ids": table.column(0).to_numpy(zero_copy_only=False), "words": words.hash, "start": words.start, "count": words.count, "fp": value[order], "fp_doc": doc[order], "fp_pos": position[order]}
        return docs.mapInArrow(_probe(test, rewriter, k, window, span), f"doc_id {d_type}, passage_id {p_type}").distinct()
    prints = _fingerprinter(rewriter, k, window)
    left = docs.mapInArrow(prints, f"id {d_type}, fp long").distinct().withColumnRenamed("id", "doc_id")
    right = tests.mapInArrow(prints, f"id {p_type}, fp long").distinct().withColumnRenamed("id", "passage_id")
    hits = cut(left.join(right, "fp").select("doc_id", "passage_id").distinct())
    both = hits.join(docs.toDF("doc_id", "doc_text"), "doc_id").join(tests.toDF("passage_id", "passage_text"), "passage_id")
    return both.select("doc_id", "doc_text", "passage_id", "passage_text").mapInArrow(_extender(rewriter, k, window, span), f"doc_id {d_type}, passage_id {p_type}").distinct()
