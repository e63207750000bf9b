"""Overlaps between evaluation and training splits by an edit-distance segment join on words.

The segments of an evaluation text of n words are its runs of SEGMENT words. Whatever words are dropped, changed or put in and however
blocks are cut and moved, as long as half of the distinct runs of three words stay common, (n - 8) / 3 or more of the segments
stay whole (runs that repeat within a text aside); the same holds for the runs of the training text. So one less than that many may be left
out as keys on either side, the first ones in one common order of all segments; that order begins with those that most evaluation texts
share, so phrases of common templates make hardly any candidates. (The last whole segment in that order is a key on both sides.)

Training texts are matched at every position. Let k = g // 9 for the g distinct runs of three words of the evaluation text. A pair
within k word edits shares a segment at an allowed position (shifted by at most k, lengths within k); banded dynamic
programming admits it, and no other check is needed: an edit changes at most three runs on either side, so at least
half of all runs are common. Pairs whose differences are more than k edits, or whose segments stand at other positions (moved
blocks, texts cut short or continued), are admitted by the exact share of common runs instead.

Each key carries a signature of 128 two-bit minima, which drops pairs far below the share before they leave the join
(one pair in 4,000 exactly at the share is lost by it). A segment of more than ``hot`` evaluation texts is spread over several tasks.
Texts below ``min_words`` words have k = 0: one segment, the whole text, joined with the record's context (user and item).

Defined results: null texts and texts without words overlap nothing; a null context key excludes a
short text; repeated record ids count once; other splits than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm import kernel as K
from tastegrid.plans.scratch import cut, parallelism, ship_package

SEGMENT = 5
#: Slots of the table of how often segments occur on the evaluation side; slots that two segments share count as the more frequent.
SLOTS = 1 << 22
#: Occurrences from which a segment has an entry there.
_OFTEN = 4
#: Edits that the dynamic programming looks for at most; longer texts with more of them are decided by their share.
MOST_EDITS = 64
#: Tasks over which a segment of many evaluation texts is spread.
SPREAD = 16
#: Evaluation keys that one matching task holds.
KEYS_PER_TASK = 2_000_000
_HELD_KEYS = 500_000
_PAIRS_AT_ONCE = 2_000_000
_ENTRY = np.dtype([("key", "<u4"), ("at", "<u2"), ("n", "<u2"), ("cls", "<i8"), *((c, "<u8") for c in K.SKETCH)])
_KEYS = "key long, at int, n int, cls long, s0 long, s1 long, s2 long, s3 long"


def _context_hash(column: pa.Array) -> np.ndarray:
    words = [None if v is None else str(v).encode("utf-8", "surrogatepass") for v in column.to_pylist()]
    out = np.zeros(len(words), np.uint64)
    length = np.fromiter((len(w) if w else 0 for w in words), np.int64, len(words))
    codes = np.frombuffer(b"".join(w for w in words if w), np.uint8)
    if len(codes):
        some = length > 0
        first = np.concatenate(([0], np.cumsum(length[some])[:-1]))
        position = np.arange(len(codes)) - np.repeat(first, length[some])
        out[some] = np.add.reduceat(K.mix64(codes.astype(np.uint64)) * K.powers(int(length.max()))[position], first)
    return K.mix64(out + length.astype(np.uint64))


class _Texts:
    """Words, class hashes and long/short marks of one slice of (text, context...) rows."""

    def __init__(self, batch: pa.RecordBatch, begin: int, texts: list[str | None], context: list[int], min_words: int) -> None:
        words = K.ascii_words(texts)
        usable = words.count > 0
        short = usable & (words.count < min_words)
        for c in context:
            usable &= ~short | ~batch.column(c).slice(begin, len(texts)).is_null().to_numpy(zero_copy_only=False)
        self.rows = np.flatnonzero(usable)
        self.words = K.select(words, usable)
        self.cls = K.sequence_hash(self.words).view(np.uint64)
        self.short = self.words.count < min_words
        if self.short.any():
            at = np.flatnonzero(self.short)
            mixed = self.cls[at]
            for c in context:
                mixed = K.mix64(mixed ^ _context_hash(batch.column(c).take(pa.array(self.rows[at] + begin))))
            self.cls[at] = mixed

    def first_of_class(self) -> np.ndarray:
        keep = np.zeros(len(self.cls), bool)
        keep[np.unique(self.cls, return_index=True)[1]] = True
        return keep


def left_out(n: np.ndarray) -> np.ndarray:
    """How many segments of a text of n words may be left out as keys: one less than always stay whole."""
    return np.maximum(-((8 - n) // 3) - 1, 0)


def _keys(t: _Texts, seed: int, shingle: int, levels: np.ndarray, passes: K.BitFilter | None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys, entries) of the long texts' segments and of the short texts as a whole; without those that may be left out."""
    keep = t.first_of_class()
    words, cls, short = K.select(t.words, keep), t.cls[keep], t.short[keep]
    value, doc, position = K.grams(words, SEGMENT)
    fits = ~short[doc]
    if len(value):
        level = levels[(value % np.uint64(SLOTS)).astype(np.int64)]
        order = np.lexsort((value, -level.astype(np.int64), doc))
        place = np.empty(len(value), np.int64)
        place[order] = np.arange(len(value)) - np.searchsorted(doc, doc[order])
        fits &= place >= left_out(words.count)[doc]
    whole = np.flatnonzero(short)
    value, doc, position = np.concatenate((value[fits], cls[whole])), np.concatenate((doc[fits], whole)), np.concatenate((position[fits], np.zeros(len(whole), np.int64)))
    if passes is not None and len(value):
        hit = passes.mask(value)
        value, doc, position = value[hit], doc[hit], position[hit]
    entry = np.zeros(len(value), _ENTRY)
    used = np.zeros(len(cls), bool)
    used[doc] = True
    used &= ~short
    if used.any():
        v, d, _ = K.grams(K.select(words, used), shingle)
        counts = np.bincount(d, minlength=int(used.sum()))
        number = np.cumsum(used) - 1
        long = used[doc]
        for name, plane in zip(K.SKETCH, K.sketches(K.minima(v, np.concatenate(([0], np.cumsum(counts)[:-1])), K.SKETCH_MINIMA, seed))):
            entry[name][long] = plane.view(np.uint64)[number[doc[long]]]
    entry["key"] = value & np.uint64(0xFFFFFFFF)
    entry["at"] = np.minimum(position, 65535)
    entry["n"] = np.minimum(words.count[doc], 65535)
    entry["cls"] = cls.view(np.int64)[doc]
    return value, entry


def _segment_mapper(min_words: int, context: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in K.slices(batch.column(0)):
                t = _Texts(batch, begin, texts, list(range(1, 1 + context)), min_words)
                value, doc, _ = K.grams(K.select(t.words, t.first_of_class()), SEGMENT)
                yield pa.record_batch([pa.array(value.view(np.int64))], names=["key"])

    return run


def _levels(segments: DataFrame) -> np.ndarray:
    """Logarithm of the occurrences of frequent segments by slot; at most SLOTS entries reach the driver."""
    often = segments.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > _OFTEN)
    slots = often.groupBy(F.pmod("key", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.max(4 * F.log2("times")).cast("int").alias("level")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    table[slots.column(0).to_numpy()] = slots.column(1).to_numpy()
    return table


def _eval_mapper(min_words: int, shingle: int, seed: int, context: int, levels) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in K.slices(batch.column(0)):
                t = _Texts(batch, begin, texts, list(range(1, 1 + context)), min_words)
                if len(t.rows):
                    value, e = _keys(t, seed, shingle, levels.value, None)
                    columns = [pa.array(value.view(np.int64)), pa.array(e["at"].astype(np.int32)), pa.array(e["n"].astype(np.int32)), *(pa.array(e[c].copy().view(np.int64)) for c in ("cls", *K.SKETCH))]
                    yield pa.record_batch(columns, names=["key", "at", "n", "cls", *K.SKETCH])

    return run


def _packed(value: np.ndarray, entry: np.ndarray, part: np.ndarray, side: int) -> pa.RecordBatch:
    """One row per partition with its entries in one piece."""
    order = np.argsort(part, kind="stable")
    part, entry = part[order], entry[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))
    bodies = pa.array([entry[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())
    return pa.record_batch([pa.array(part[begin].astype(np.int32)), pa.array(np.full(len(begin), side, np.int32)), bodies], names=["part", "side", "body"])


def _home(value: np.ndarray, parts: int) -> np.ndarray:
    return ((value >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _eval_packer(parts: int, hot: K.BitFilter | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy().view(np.uint64)
            if not len(value):
                continue
            entry = np.zeros(len(value), _ENTRY)
            entry["key"] = value & np.uint64(0xFFFFFFFF)
            for i, c in enumerate(("at", "n", "cls"), 1):
                entry[c] = batch.column(i).to_numpy()
            for i, c in enumerate(K.SKETCH, 4):
                entry[c] = batch.column(i).to_numpy().view(np.uint64)
            part = _home(value, parts)
            yield _packed(value, entry, part, 0)
            if hot is not None and (often := hot.mask(value)).any():
                for step in range(1, min(SPREAD, parts)):
                    yield _packed(value[often], entry[often], (part[often] + step) % parts, 0)

    return run


def _train_mapper(min_words: int, shingle: int, seed: int, context: int, parts: int, levels, known: K.BitFilter, hot: K.BitFilter | None) -> Callable:
    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        value, entry = (np.concatenate(x) for x in zip(*held))
        part = _home(value, parts)
        if hot is not None:
            often = hot.mask(value)
            part[often] = (part[often] + (entry["cls"][often].view(np.uint64) % np.uint64(min(SPREAD, parts))).astype(np.int64)) % parts
        return _packed(value, entry, part, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for begin, texts in K.slices(batch.column(0)):
                t = _Texts(batch, begin, texts, list(range(1, 1 + context)), min_words)
                if not len(t.rows):
                    continue
                value, entry = _keys(t, seed, shingle, levels.value, known)
                if len(value):
                    held.append((value, entry))
                    size += len(value)
                if size >= _HELD_KEYS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _matcher(min_words: int, limit: int) -> Callable:
    """Class pairs (cls_e, cls_t, placed) of equal keys; ``placed`` tells whether the segment stands at an allowed position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        index = None
        for batch in batches:
            for side, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                entry = np.frombuffer(body, _ENTRY)
                if side == 0:
                    held.append(entry)
                    continue
                if index is None:
                    if not held:
                        return
                    index = np.concatenate(held)
                    index = index[np.argsort(index["key"], kind="stable")]
                    keys = index["key"].copy()
                    held = []
                lo, hi = np.searchsorted(keys, entry["key"], "left"), np.searchsorted(keys, entry["key"], "right")
                some = np.flatnonzero(hi > lo)
                entry, lo, upto = entry[some], lo[some], np.cumsum((hi - lo)[some])
                total = int(upto[-1]) if len(upto) else 0
                for begin in range(0, total, _PAIRS_AT_ONCE):
                    flat = np.arange(begin, min(begin + _PAIRS_AT_ONCE, total))
                    row = np.searchsorted(upto, flat, "right")
                    t = entry[row]
                    e = index[lo[row] + flat - np.where(row > 0, upto[row - 1], 0)]
                    apart = np.bitwise_count((e["s0"] ^ t["s0"]) | (e["s2"] ^ t["s2"])) + np.bitwise_count((e["s1"] ^ t["s1"]) | (e["s3"] ^ t["s3"]))
                    short = (e["n"] < min_words) | (t["n"] < min_words)
                    keep = np.where(short, e["cls"] == t["cls"], apart <= limit)
                    e, t = e[keep], t[keep]
                    if not len(e):
                        continue
                    k = e["n"].astype(np.int64) // 9
                    placed = (np.abs(e["at"].astype(np.int64) - t["at"]) <= k) & (np.abs(e["n"].astype(np.int64) - t["n"]) <= k)
                    order = np.lexsort((~placed, t["cls"], e["cls"]))
                    ce, ct, placed = e["cls"][order], t["cls"][order], placed[order]
                    first = np.concatenate(([True], (ce[1:] != ce[:-1]) | (ct[1:] != ct[:-1])))
                    yield pa.record_batch([pa.array(ce[first]), pa.array(ct[first]), pa.array(placed[first])], names=["cls_e", "cls_t", "placed"])

    return run


def _member_mapper(min_words: int, context: int, rid: int, wanted: K.BitFilter) -> Callable:
    schema = pa.schema([("cls", pa.int64()), ("rid", pa.string()), ("words", pa.binary()), ("context", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in K.slices(batch.column(0)):
                t = _Texts(batch, begin, texts, list(range(1, 1 + context)), min_words)
                keep = wanted.mask(t.cls) if len(t.rows) else np.zeros(0, bool)
                if not keep.any():
                    continue
                first = t.first_of_class()
                at = np.flatnonzero(keep)
                rows = pa.array(t.rows[at] + begin)
                words = [t.words.of(i).tobytes() if first[i] else None for i in at]
                columns = [batch.column(c).take(rows).to_pylist() for c in range(1, 1 + context)]
                extra = [[str(c[j]) for c in columns] if t.short[i] else None for j, i in enumerate(at)]
                yield pa.record_batch([pa.array(t.cls.view(np.int64)[at]), batch.column(rid).take(rows).cast(pa.string()), pa.array(words, pa.binary()), pa.array(extra, pa.list_(pa.string()))], schema=schema)

    return run


def _verifier(similarity: float, min_words: int, shingle: int) -> Callable:
    numerator, denominator = round(similarity * 1000), 1000
    schema = pa.schema([("cls_e", pa.int64()), ("cls_t", pa.int64()), ("word_edits", pa.int32()), ("similarity", pa.float64())])
    # e edits leave common >= g - shingle * e and either <= g + shingle * e of g distinct runs
    per_edit = shingle * (1 + similarity) / (1 - similarity) if similarity < 1 else float("inf")

    def distinct(w: np.ndarray) -> np.ndarray:
        return np.unique(K.grams(K.Words(w, np.zeros(len(w), np.int64), 1), shingle)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, t, placed = (batch.column(i).to_pylist() for i in range(3))
            a, b = ([np.frombuffer(w, np.uint64) for w in batch.column(i).to_pylist()] for i in (3, 4))
            context_e, context_t = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            out: list[tuple] = []
            long, runs, most = [], [], []
            known: dict[int, np.ndarray] = {}
            for i in range(len(e)):
                if len(a[i]) < min_words or len(b[i]) < min_words:
                    if np.array_equal(a[i], b[i]) and context_e[i] == context_t[i]:
                        out.append((e[i], t[i], 0, 1.0))
                    continue
                if e[i] not in known:
                    known[e[i]] = distinct(a[i])
                long.append(i)
                runs.append(known[e[i]])
                most.append(min(int(len(runs[-1]) / per_edit), MOST_EDITS) if placed[i] else -1)
            edits = K.word_edits([a[i] for i in long], [b[i] for i in long], np.array(most, np.int64)) if long else []
            for i, ga, d in zip(long, runs, edits):
                if d >= 0:
                    out.append((e[i], t[i], int(d), None))
                    continue
                gb = distinct(b[i])
                common = len(np.intersect1d(ga, gb, assume_unique=True))
                either = len(ga) + len(gb) - common
                if common * denominator >= numerator * either:
                    out.append((e[i], t[i], None, common / either))
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def overlaps(records: DataFrame, id_col: str, text_col: str, is_eval: Column, is_train: Column, *, context: tuple[str, ...] = (), shingle: int = 3, similarity: float = 0.5, min_words: int = 20, seed: int = 11, hot: int = 256) -> DataFrame:
    """(eval_id, train_id, word_edits, similarity): one row per overlapping pair of an evaluation and a training record.

    ``word_edits`` is the word edit distance where it admitted the pair, else null; ``similarity`` the share of
    common distinct ``shingle``-word runs where it did, 1 for equal short texts, else null. The cut into segments
    is made for runs of three words and a share of a half or more; others are refused.
    """
    if shingle != 3 or similarity < 0.5:
        raise ValueError("segments are made for runs of three words and a similarity of 0.5 or more")
    spark = records.sparkSession
    ship_package(spark)
    n = len(context)
    source = records.select(F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(context)), F.col(id_col).cast("string").alias("rid"), is_eval.alias("is_eval"), is_train.alias("is_train")).where("text is not null and rid is not null")
    evals, trains = source.where("is_eval").drop("is_eval", "is_train"), source.where("is_train").drop("is_eval", "is_train")
    levels = spark.sparkContext.broadcast(_levels(evals.mapInArrow(_segment_mapper(min_words, n), "key long")))
    segments = cut(evals.mapInArrow(_eval_mapper(min_words, shingle, seed, n, levels), _KEYS).distinct())
    known = K.bit_filter(segments, "key")
    often = cut(segments.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > hot).select("key"))
    spread = K.bit_filter(often, "key") if often.head(1) else None
    parts = max(parallelism(spark), -(-segments.count() // KEYS_PER_TASK))
    packs = "part int, side int, body binary"
    both = segments.mapInArrow(_eval_packer(parts, spread), packs).unionByName(trains.mapInArrow(_train_mapper(min_words, shingle, seed, n, parts, levels, known, spread), packs))
    matched = both.repartitionById(parts, F.col("part")).sortWithinPartitions("side").mapInArrow(_matcher(min_words, K.sketch_limit(similarity)), "cls_e long, cls_t long, placed boolean")
    near = cut(matched.groupBy("cls_e", "cls_t").agg(F.max("placed").alias("placed")))
    member = "cls long, rid string, words binary, context array<string>"

    def members(rows: DataFrame, x: str) -> DataFrame:
        ids = cut(near.select(F.col(f"cls_{x}").alias("cls")).distinct())
        return cut(rows.mapInArrow(_member_mapper(min_words, n, n + 1, K.bit_filter(ids, "cls")), member).join(ids, "cls", "left_semi"))

    def texts(full: DataFrame, x: str) -> DataFrame:
        return full.where("words is not null").groupBy("cls").agg(F.first("words").alias("words"), F.first("context").alias("context")).toDF(f"cls_{x}", f"words_{x}", f"context_{x}")

    e_full, t_full = members(evals, "e"), members(trains, "t")
    paired = near.join(texts(e_full, "e"), "cls_e").join(texts(t_full, "t"), "cls_t").select("cls_e", "cls_t", "placed", "words_e", "words_t", "context_e", "context_t")
    sure = cut(paired.mapInArrow(_verifier(similarity, min_words, shingle), "cls_e long, cls_t long, word_edits int, similarity double"))
    left = e_full.select(F.col("cls").alias("cls_e"), F.col("rid").alias("eval_id")).distinct()
    right = t_full.select(F.col("cls").alias("cls_t"), F.col("rid").alias("train_id")).distinct()
    pairs = sure.join(left, "cls_e").join(right, "cls_t").where("eval_id <> train_id")
    return pairs.groupBy("eval_id", "train_id").agg(F.min("word_edits").alias("word_edits"), F.max("similarity").alias("similarity"))
