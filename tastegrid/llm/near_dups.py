"""Near-duplicate texts: min-hash banding, signature check, exact check, star-contraction components.

A text's *class* is the 64-bit hash of its whole word sequence, so repeated texts are one class from the first step on and a
hot text costs one key per task, not one per row. A text of fewer words than a run, or than ``whole_below``, has one run,
its whole word sequence, so it is linked to equal texts only.

Buckets of one band key are handled in two ways. With ``all_pairs`` every pair of a bucket is a candidate: those of at most
``most`` classes list their pairs, larger ones are compared by signature in tiles of blocks x blocks spread over the cluster, and only
pairs that pass leave a tile. Without it (groups need only a connected graph) each member is linked to the bucket's least class;
members whose link does not hold are compared with all members of the bucket, again in tiles. Pairs left out this way are
those of two members both linked to the least class, which are in one group already: the groups are those of all pairs.

Banding misses at most 1.6 % of the pairs exactly at the threshold, 0.2 % ten per cent above it (``Bands`` with more bands misses
fewer). A miss of 0 needs an exact join of runs, as in the queries' SQL.

Defined results: null texts and texts of fewer than ``min_words`` words belong to no
pair and no group; repeated record ids count once; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.llm import kernel as K
from tastegrid.plans.scratch import cut, parallelism, ship_package

#: Band keys that one reducing task sorts at once.
KEYS_PER_TASK = 1_200_000
#: Band keys a mapping task holds before it hands them on.
_HELD_KEYS = 2_000_000
#: Classes of a bucket whose pairs are listed at once; larger buckets go through tiles.
MOST_IN_BUCKET = 128
#: Classes per side of a tile.
BLOCK = 2048


@dataclass(frozen=True)
class Bands:
    """``bands`` groups of ``rows`` minima: similarity s becomes a candidate with 1-(1-s**rows)**bands."""

    rows: int
    bands: int


def bands_for(similarity: float, miss: float = 0.016, most: int = 65) -> Bands:
    """Longest bands that miss at most ``miss`` of the pairs exactly at the threshold, within ``most`` bands."""
    for rows in range(10, 0, -1):
        need = int(np.ceil(np.log(miss) / np.log1p(-(similarity**rows)))) if similarity**rows < 1 else 1
        if need <= most:
            return Bands(rows, need)
    raise ValueError("no banding reaches this similarity")


def _prepared(texts: list[str | None], min_words: int) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Long enough texts: their words, their positions in ``texts``, their class hashes."""
    words = K.ascii_words(texts)
    keep = words.count >= max(min_words, 1)
    rows = np.flatnonzero(keep)
    words = K.select(words, keep)
    return words, rows, K.sequence_hash(words)


def _runs(words: K.Words, cls: np.ndarray, k: int, whole_below: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of every run of k words, texts in order; the class of a text of fewer words than k or ``whole_below`` is its one run."""
    value, doc, _ = K.grams(words, k)
    short = words.count < max(k, whole_below)
    if not short.any():
        return value, doc
    long = ~short[doc]
    at = np.flatnonzero(short)
    value, doc = np.concatenate((value[long], cls[at].view(np.uint64))), np.concatenate((doc[long], at))
    order = np.argsort(doc, kind="stable")
    return value[order], doc[order]


def _starts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    counts = np.bincount(doc, minlength=n_docs)
    return np.concatenate(([0], np.cumsum(counts)[:-1])) if n_docs else counts


@dataclass(frozen=True)
class _Shape:
    """What a text's runs are: words per run, least words of a text, words below which a text is one run."""

    k: int
    min_words: int
    whole_below: int


def _key_mapper(shape: _Shape, bands: Bands, parts: int, seed: int) -> Callable:
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cls = np.concatenate([c for c, _ in held])
        keys = np.concatenate([b for _, b in held], axis=1)
        _, first, times = np.unique(cls, return_index=True, return_counts=True)
        repeated = first[times > 1]
        key = np.concatenate([keys[:, first].ravel(), keys[0, repeated]])
        owner = np.concatenate([np.tile(cls[first], len(keys)), cls[repeated]])
        part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, key, owner = part[order], key[order].astype(np.uint32), owner[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))
        yield pa.record_batch([pa.array(part[begin], pa.int32()), pa.array([key[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, texts in K.slices(batch.column(0)):
                words, rows, cls = _prepared(texts, shape.min_words)
                if not len(rows):
                    continue
                value, doc = _runs(words, cls, shape.k, shape.whole_below)
                minimum = K.minima(value, _starts(doc, len(rows)), bands.rows * bands.bands, seed).astype(np.uint64)
                key = np.repeat(np.arange(bands.bands, dtype=np.uint64)[:, None], len(rows), axis=1)
                for r in range(bands.rows):
                    key = key * np.uint64(0xD1342543DE82EF95) + minimum[r :: bands.rows]
                held.append((cls, K.mix64(key)))
                size += key.size
                if size >= _HELD_KEYS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


_HITS = "key long, a long, b long"


def _buckets(most: int, all_pairs: bool) -> Callable:
    """(key, a, b) with a null key: candidate pair a < b, or a == b where one class came twice. With a key and null b: ``a`` is in a bucket that goes through tiles."""

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, ids = [], [], []
        for batch in batches:
            for p, k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys.append(np.frombuffer(k, np.uint32))
                ids.append(np.frombuffer(i, np.int64))
                parts.append(np.full(len(keys[-1]), p, np.uint64))
        if not keys:
            return
        key = (np.concatenate(parts) << np.uint64(32)) | np.concatenate(keys)
        owner = np.concatenate(ids)
        del parts, keys, ids
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        del order
        # a class that several tasks delivered is marked as repeated and stays once in its bucket
        again = np.concatenate(([False], (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])))
        if again.any():
            twice = np.unique(owner[again])
            yield pairs(twice, twice)
            key, owner = key[~again], owner[~again]
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin = np.concatenate(([0], edge))
        size = np.diff(np.concatenate((begin, [len(key)])))
        if all_pairs:
            for n in np.unique(size[(size > 1) & (size <= most)]):
                first = begin[size == n]
                for gap in range(1, n):
                    for block in range(0, len(first), 500_000):
                        at = (first[block : block + 500_000, None] + np.arange(n - gap)).ravel()
                        yield pairs(owner[at], owner[at + gap])
        else:
            head = np.repeat(begin, size)
            member = np.flatnonzero(head != np.arange(len(key)))
            for block in range(0, len(member), 500_000):
                at = member[block : block + 500_000]
                yield pairs(owner[head[at]], owner[at])
        tiled = np.flatnonzero(np.repeat(size, size) > (most if all_pairs else 2))
        for block in range(0, len(tiled), 500_000):
            at = tiled[block : block + 500_000]
            yield pa.record_batch([pa.array(key[at].view(np.int64)), pa.array(owner[at]), pa.nulls(len(at), pa.int64())], names=["key", "a", "b"])

    return run


def _sketch_mapper(shape: _Shape, seed: int, wanted: K.BitFilter) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in K.slices(batch.column(0)):
                words, rows, cls = _prepared(texts, shape.min_words)
                if not len(rows):
                    continue
                _, first = np.unique(cls, return_index=True)
                keep = np.zeros(len(rows), bool)
                keep[first] = True
                keep &= wanted.mask(cls)
                if not keep.any():
                    continue
                words, cls = K.select(words, keep), cls[keep]
                value, doc = _runs(words, cls, shape.k, shape.whole_below)
                parts = K.sketches(K.minima(value, _starts(doc, len(cls)), K.SKETCH_MINIMA, seed))
                yield pa.record_batch([pa.array(cls), *map(pa.array, parts)], names=["cls", *K.SKETCH])

    return run


def _compare(limit: int) -> Callable:
    """Pairs (a, b), a < b, of a tile's sides whose signatures are near; rows arrive sorted by tile."""

    def near(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, cls, sketch = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows], axis=1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for begin in range(0, len(left), 256):
            x, y = sketch[:, left[begin : begin + 256], None], sketch[:, None, right]
            apart = np.bitwise_count((x[0] ^ y[0]) | (x[2] ^ y[2])) + np.bitwise_count((x[1] ^ y[1]) | (x[3] ^ y[3]))
            i, j = np.nonzero(apart <= limit)
            a, b = cls[left[begin + i]], cls[right[j]]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            tile = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            sketch = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(5, 9)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                name = tuple(tile[:, a])
                if name != current and held:
                    yield from near(held)
                    held = []
                current = name
                held.append((batch.column(3).to_numpy()[a:b], batch.column(4).to_numpy()[a:b], sketch[:, a:b]))
        if held:
            yield from near(held)

    return run


def _tiled_pairs(left: DataFrame, right: DataFrame, sketch: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b: classes of ``left`` and ``right`` (key, cls) in the same bucket whose signatures are near; each side is cut into blocks
    and every pair of blocks is a task's tile, so a bucket of any size is spread over the cluster and its pairs never leave a tile unless near."""

    def blocked(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        return rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    l, r = blocked(left), blocked(right)
    l_blocks, r_blocks = (x.groupBy("key").agg(F.max("blocks").alias("others")) for x in (l, r))
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    one = l.join(r_blocks, "key").select("key", F.col("block").alias("i"), every.alias("j"), F.lit(0).alias("side"), "cls")
    two = r.join(l_blocks, "key").select("key", every.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "cls")
    full = one.unionByName(two).join(sketch, "cls").select("key", "i", "j", "side", "cls", *K.SKETCH)
    return full.repartition(parallelism(left.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(limit), "a long, b long").distinct()


def _member_mapper(shape: _Shape, wanted: K.BitFilter) -> Callable:
    schema = pa.schema([("cls", pa.int64()), ("rid", pa.string()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in K.slices(batch.column(1)):
                words, rows, cls = _prepared(texts, shape.min_words)
                keep = wanted.mask(cls) if len(cls) else np.zeros(0, bool)
                if not keep.any():
                    continue
                words, rows, cls = K.select(words, keep), rows[keep], cls[keep]
                value, doc = _runs(words, cls, shape.k, shape.whole_below)
                start = np.concatenate((_starts(doc, len(rows)), [len(value)]))
                _, first = np.unique(cls, return_index=True)
                sets: list[bytes | None] = [None] * len(rows)
                for i in first:
                    sets[i] = K.distinct_sorted(value[start[i] : start[i + 1]])
                rids = batch.column(0).take(pa.array(rows + begin))
                yield pa.record_batch([pa.array(cls), rids.cast(pa.string()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _verifier(similarity: float) -> Callable:
    numerator, denominator = round(similarity * 1000), 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            keep, score = [], []
            for i, (a, b) in enumerate(zip(left, right)):
                common, either = K.shared_of(a, b)
                if common * denominator >= numerator * either:
                    keep.append(i)
                    score.append(common / either)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(score, pa.float64())], names=["cls_a", "cls_b", "similarity"])

    return run


@dataclass
class NearDuplicates:
    """Result of ``find``: linked classes, and the records of every linked or repeated class."""

    links: DataFrame  # cls_a, cls_b, similarity: one row per unordered pair of different classes; without all_pairs a part of them that connects the same classes
    members: DataFrame  # cls, rid


def find(records: DataFrame, id_col: str, text_col: str, *, shingle: int = 5, similarity: float = 0.8, min_words: int = 1, whole_below: int = 0, bands: Bands | None = None, seed: int = 7, all_pairs: bool = True, most: int = MOST_IN_BUCKET) -> NearDuplicates:
    """Pairs of texts whose sets of ``shingle``-word runs have Jaccard similarity of at least ``similarity``.

    Candidates come from min-hash bands, are thinned by a signature of 128 two-bit minima and decided
    exactly on the full sets. ``bands`` defaults to the longest bands that lose at most 1.6 % of
    pairs exactly at the threshold (and quickly fewer above it).
    """
    spark = records.sparkSession
    ship_package(spark)
    bands = bands or bands_for(similarity)
    shape = _Shape(shingle, min_words, whole_below)
    limit = K.sketch_limit(similarity)
    source = records.select(F.col(id_col).cast("string").alias("rid"), F.col(text_col).alias("text")).where(F.col("rid").isNotNull() & F.col("text").isNotNull())
    texts = source.select("text")
    parts = max(parallelism(spark), -(-records.count() * bands.bands // KEYS_PER_TASK))
    keys = texts.mapInArrow(_key_mapper(shape, bands, parts, seed), "part int, keys binary, ids binary")
    hits = cut(keys.repartitionById(parts, F.col("part")).mapInArrow(_buckets(most, all_pairs), _HITS).distinct())
    listed = hits.where("key is null").select("a", "b")
    tiled = hits.where("key is not null").select("key", F.col("a").alias("cls"))
    met = cut(listed.where("a <> b").select(F.explode(F.array("a", "b")).alias("cls")).union(tiled.select("cls")).distinct())
    sketch = texts.mapInArrow(_sketch_mapper(shape, seed + 1, K.bit_filter(met, "cls")), "cls long, s0 long, s1 long, s2 long, s3 long").groupBy("cls").agg(*(F.first(c).alias(c) for c in K.SKETCH))
    some_tiled = bool(tiled.head(1))
    if some_tiled:
        sketch = cut(sketch)

    def near(pairs: DataFrame) -> DataFrame:
        left, right = (sketch.toDF(side, *(f"{side}_{c}" for c in K.SKETCH)) for side in "ab")
        return pairs.where("a <> b").join(left, "a").join(right, "b").where(K.sketch_distance("a", "b") <= limit).select("a", "b")

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of the stored pairs that hold, and the records of all their classes."""
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        chosen = source.mapInArrow(_member_mapper(shape, K.bit_filter(wanted, "cls")), "cls long, rid string, grams binary")
        full = cut(chosen.join(wanted, "cls", "left_semi"))
        sets = full.where(F.col("grams").isNotNull()).groupBy("cls").agg(F.first("grams").alias("grams"))
        paired = pairs.where("a <> b").join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b").select("a", "grams_a", "b", "grams_b")
        links = paired.mapInArrow(_verifier(similarity), "cls_a long, cls_b long, similarity double")
        return cut(links), full.select("cls", "rid").distinct()

    close = near(listed)
    if all_pairs and some_tiled:
        close = close.union(_tiled_pairs(tiled, tiled, sketch, limit))
    links, members = linked(cut(close.distinct().union(listed.where("a = b"))))
    if not all_pairs and some_tiled:
        lead = tiled.groupBy("key").agg(F.min("cls").alias("lead"))
        held = links.select(F.col("cls_a").alias("lead"), F.col("cls_b").alias("cls"))
        failed = cut(tiled.join(lead, "key").where("cls <> lead").join(held, ["lead", "cls"], "left_anti").select("key", "cls"))
        more, more_members = linked(cut(_tiled_pairs(failed, tiled, sketch, limit).join(links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")), ["a", "b"], "left_anti")))
        links, members = links.union(more), members.union(more_members).distinct()
    return NearDuplicates(links, members)


def record_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs of records of linked classes and of one class, as (rid_a, rid_b) with rid_a < rid_b.

    This lists copies pair by pair, as its callers' result demands; ``groups`` does not.
    """
    copies = found.members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    both = found.links.select("cls_a", "cls_b").union(copies)
    left, right = found.members.toDF("cls_a", "x"), found.members.toDF("cls_b", "y")
    pairs = both.join(left, "cls_a").join(right, "cls_b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("rid_a"), F.greatest("x", "y").alias("rid_b")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of the connected components of ``edges(u, v)``; root is the least node.

    Alternates large-star and small-star until no edge changes; each round is one pass over
    the edges and at most a logarithmic number of rounds is needed. Hubs are never gathered:
    a node's least neighbour is a map-side combined minimum joined back to its edges.
    """
    now = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct()

    def signature(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    last = signature(now)
    for _ in range(limit):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        now = cut(small.where("u <> v").distinct())
        seen = signature(now)
        if seen == last:
            roots = now.groupBy("v").agg(F.min("u").alias("root"))
            return nodes.join(roots, nodes.node == roots.v, "left").select("node", F.coalesce("root", "node").alias("root"))
        last = seen
    raise RuntimeError(f"components still change after {limit} rounds")


def groups(found: NearDuplicates, everyone: DataFrame | None = None) -> DataFrame:
    """(rid, group_id): the records with a near-duplicate or copy and their group, named by its least record id.

    With ``everyone``, whose first column holds record ids, each of them has a row: a record without a partner is a group of its own.
    """
    roots = components(found.links.select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v")))
    placed = found.members.join(roots, F.col("cls") == F.col("node"), "left").select("rid", F.coalesce("root", "cls").alias("root"))
    named = placed.groupBy("root").agg(F.min("rid").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    grouped = placed.join(named, "root").select("rid", "group_id")
    if everyone is None:
        return grouped
    ids = everyone.select(F.col(everyone.columns[0]).cast("string").alias("rid")).where("rid is not null").distinct()
    return ids.join(grouped, "rid", "left").select("rid", F.coalesce("group_id", "rid").alias("group_id"))


def link_counts(found: NearDuplicates) -> DataFrame:
    """(rid, n_links): other texts linked to the text of every record that has a near-duplicate or copy; ``found`` with all pairs."""
    ends = found.links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"))
    degree = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    copies = found.members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    some = degree.join(copies, "cls", "full").select("cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.members.join(some, "cls").select("rid", "n_links")
