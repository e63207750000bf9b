"""Vectorised text kernels shared by the operators on word runs.

A batch of texts becomes one code array; words, word hashes, shingle hashes and
minima are then computed with NumPy over the whole batch, never text by text.
Hashes are 64 bits wide; words of any length and texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from tastegrid.plans.scratch import parallelism

SEED = 0x9E3779B97F4A7C15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Characters handled at once; bounds a worker's memory whatever Arrow's batch holds.
SLICE_CHARS = 1_500_000


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x + _STEP).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


class Words:
    """Words of a batch: ``hash`` per word, ``doc`` its text's index, ``start``/``count`` per text."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> None:
        self.hash, self.doc = hashes, doc
        self.count = np.bincount(doc, minlength=n_docs).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.count)[:-1])) if n_docs else np.zeros(0, np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.start[i] : self.start[i] + self.count[i]]


def _word_hashes(codes: np.ndarray, is_word: np.ndarray, separators: np.ndarray, n_docs: int) -> Words:
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), n_docs)
    length = end - begin
    inside = np.flatnonzero(is_word)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    position = np.arange(len(inside)) - np.repeat(first, length)
    value = mix64(codes[inside].astype(np.uint64)) * powers(int(length.max()))[position]
    hashes = mix64(np.add.reduceat(value, first) + length.astype(np.uint64))
    return Words(hashes, np.searchsorted(separators, begin), n_docs)


def ascii_words(texts: list[str | None]) -> Words:
    """Runs of a-z and 0-9 of each lower-cased text; null texts have none."""
    joined = "\0".join("" if t is None else t.replace("\0", " ") if "\0" in t else t for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    return _word_hashes(codes, _ASCII_WORD[codes], np.flatnonzero(codes == 0), len(texts))


_LETTER: np.ndarray | None = None


def letter_words(texts: list[str | None]) -> Words:
    """Runs of letters or digits, of any script, of each text as given."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    joined = "\0".join("" if t is None else t.replace("\0", " ") if "\0" in t else t for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _word_hashes(codes, _LETTER[codes], np.flatnonzero(codes == 0), len(texts))


def slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) pieces of an Arrow column with about SLICE_CHARS characters each."""
    texts, begin, size = column.to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE_CHARS:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def select(words: Words, keep: np.ndarray) -> Words:
    """The texts marked in ``keep``, renumbered."""
    number = np.cumsum(keep) - 1
    mask = keep[words.doc]
    return Words(words.hash[mask], number[words.doc[mask]], int(keep.sum()))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, word position) of every run of k consecutive words."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    factor = powers(k + 1, 0xA24BAED4963EE407)[1:]
    for i in range(k):
        h += words.hash[i : i + n] * factor[i]
    inside = words.doc[:n] == words.doc[k - 1 :]
    where = np.flatnonzero(inside)
    doc = words.doc[where]
    return mix64(h[where]), doc, where - words.start[doc]


def sequence_hash(words: Words) -> np.ndarray:
    """Hash of each text's whole word sequence, as signed 64 bits; 0 words give a constant."""
    n_docs = len(words.count)
    out = np.zeros(n_docs, np.uint64)
    if len(words.hash):
        position = np.arange(len(words.hash)) - words.start[words.doc]
        value = words.hash * powers(int(words.count.max()), 0xC2B2AE3D27D4EB4F)[position]
        some = words.count > 0
        out[some] = np.add.reduceat(value, words.start[some])
    return mix64(out ^ words.count.astype(np.uint64)).view(np.int64)


def minima(values: np.ndarray, starts: np.ndarray, n_hashes: int, seed: int) -> np.ndarray:
    """(n_hashes, texts) minima of universal hashes a*x+b of 32 bits over each text's values.

    ``starts`` are the first indexes of the texts' runs in ``values``; every text has at least one value.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**31, n_hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, n_hashes, dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n_hashes, len(starts)), np.uint32)
    work = np.empty((8, len(x)), np.uint32)
    for i in range(0, n_hashes, 8):
        step = min(8, n_hashes - i)
        np.multiply(x[None, :], a[i : i + step, None], out=work[:step])
        work[:step] += b[i : i + step, None]
        np.minimum.reduceat(work[:step], starts, axis=1, out=out[i : i + step])
    return out


SKETCH_MINIMA = 128
#: Columns of a sketch: two planes of one bit per minimum, each in two signed 64-bit words.
SKETCH = ("s0", "s1", "s2", "s3")


def sketches(minimum: np.ndarray) -> list[np.ndarray]:
    """Two bits of each minimum, as signed 64-bit words per text: all words of the first bits, then of the second."""
    mixed = minimum * np.uint32(0x9E3779B1)
    out = []
    for shift in (31, 30):
        bits = ((mixed >> np.uint32(shift)) & np.uint32(1)).astype(np.uint8)
        words = np.packbits(bits, axis=0).T.copy().view(np.int64)
        out += [words[:, i].copy() for i in range(words.shape[1])]
    return out


def sketch_distance(left: str, right: str) -> Column:
    """Minima whose two bits differ, over the sketch columns with these prefixes."""
    l, r = ([F.col(f"{side}_{c}") for c in SKETCH] for side in (left, right))
    x = [a.bitwiseXOR(b) for a, b in zip(l, r)]
    return F.bit_count(x[0].bitwiseOR(x[2])) + F.bit_count(x[1].bitwiseOR(x[3]))


def sketch_limit(similarity: float, n: int = SKETCH_MINIMA) -> int:
    """Most differing minima of pairs at ``similarity``, 3.5 standard deviations out (one such pair in 4,000 is above).

    Two minima agree in both bits with probability s + (1 - s) / 4.
    """
    p = (1 - similarity) * 0.75
    return int(n * p + 3.5 * (n * p * (1 - p)) ** 0.5) + 1


def distinct_sorted(values: np.ndarray) -> bytes:
    return np.unique(values).tobytes()


def shared_of(left: bytes, right: bytes) -> tuple[int, int]:
    """(common, either) of two packed sorted sets of hashes."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, len(a) + len(b) - common


def _padded(rows: list[np.ndarray], before: int, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.uint64)
    for i, r in enumerate(rows):
        out[i, before : before + len(r)] = r
    return out


def _band(left: list[np.ndarray], right: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances within ``band`` diagonals, band + 1 above; one row of all pairs' tables is filled at a time."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    far, width = band + 1, 2 * band + 1
    out = np.full(len(n), far)
    offsets, ramp = np.arange(-band, band + 1), np.arange(width)
    a, b = _padded(left, 0, int(n.max())), _padded(right, band, int(max(n.max(), m.max())) + width)
    live = np.arange(len(n))
    row = np.tile(np.where(offsets >= 0, offsets, far), (len(n), 1))
    edge = np.full((len(n), 1), far)
    for i in range(int(n.max()) + 1):
        if i:
            j = i + offsets
            same = (b[live, i - 1 : i - 1 + width] == a[live, i - 1 : i]) & (j >= 1) & (j <= m[live, None])
            best = np.minimum(row + ~same, np.hstack((row[:, 1:], edge[: len(live)])) + 1)
            best[:, (j < 1)] = far
            if i <= band:
                best[:, band - i] = i
            best = np.minimum.accumulate(best - ramp, axis=1) + ramp
            best[(j < 0) | (j > m[live, None])] = far
            row = np.minimum(best, far)
        done = n[live] == i
        if done.any():
            out[live[done]] = row[done, band + (m - n)[live[done]]]
        keep = ~done & (row.min(axis=1) <= band)
        if not keep.all():
            live, row = live[keep], row[keep]
            if not len(live):
                break
    return out


def word_edits(left: list[np.ndarray], right: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of word sequences by banded dynamic programming; -1 where it is above ``most``.

    Bands are widened in steps, so a pair costs its length times its distance; all pairs of a step are filled together.
    """
    gap = np.array([abs(len(a) - len(b)) for a, b in zip(left, right)])
    out = np.full(len(left), -1)
    todo, band = np.flatnonzero(gap <= most), 2
    while len(todo):
        order = todo[np.argsort([len(left[i]) for i in todo], kind="stable")]
        begin = 0
        while begin < len(order):
            # table rows of a step hold at most 4 M words
            end = begin + 1
            while end < len(order) and end - begin < 4096 and (end - begin) * len(left[order[end]]) < 4_000_000:
                end += 1
            at = order[begin:end]
            inside = at[gap[at] <= band]
            if len(inside):
                d = _band([left[i] for i in inside], [right[i] for i in inside], band)
                ok = (d <= band) & (d <= most[inside])
                out[inside[ok]] = d[ok]
            begin = end
        todo = todo[(out[todo] < 0) & (most[todo] > band)]
        band *= 3
    return out


#: A filter has eight bits a key or more, within these sizes: 128 KB to 64 MB. Above 2**26 keys it lets more pass, never less.
_LEAST_BITS, _MOST_BITS = 20, 29
#: Bits of a chunk that one task fills and sends at once: 64 KB.
_CHUNK = 19


class BitFilter:
    """Membership of 64-bit hashes in a bit table that every task holds; passes all members and few others."""

    def __init__(self, table, bits: int) -> None:
        self.table, self.bits = table, bits

    def mask(self, values: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.table.value, np.uint8)
        at = values.view(np.uint64) & np.uint64(self.bits - 1)
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _fill_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = np.unique(batch.column(0).to_numpy())
        number = at >> _CHUNK
        cuts = np.flatnonzero(np.diff(number)) + 1
        for piece in np.split(at, cuts):
            if len(piece):
                table = chunks.setdefault(int(piece[0]) >> _CHUNK, np.zeros(1 << (_CHUNK - 3), np.uint8))
                inside = piece & ((1 << _CHUNK) - 1)
                byte, first = np.unique(inside >> 3, return_index=True)
                table[byte] |= np.bitwise_or.reduceat(np.left_shift(1, inside & 7).astype(np.uint8), first)
    if chunks:
        yield pa.record_batch([pa.array(list(chunks), pa.int32()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], names=["chunk", "bits"])


def bit_filter(df, column: str) -> BitFilter:
    """Filter of the hashes in a column of a stored table; built by the executors, the driver gathers at most 64 MB of bits."""
    spark = df.sparkSession
    bits = 1 << min(_MOST_BITS, max(_LEAST_BITS, (8 * df.count()).bit_length()))
    at = df.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("at"))
    chunks = at.repartition(parallelism(spark), F.shiftright("at", _CHUNK)).mapInArrow(_fill_chunks, "chunk int, bits binary")
    table = bytearray(bits // 8)
    for row in chunks.collect():
        begin = row.chunk << (_CHUNK - 3)
        table[begin : begin + len(row.bits)] = row.bits
    return BitFilter(spark.sparkContext.broadcast(bytes(table)), bits)
