"""Items that appear together: blocked Gram matrix over baskets, with lift over chance.

Baskets become rows of a binary record-by-item matrix. Per block of records the transpose-product
is summed inside the task, so only distinct item pairs of a block are shuffled; the products of all
blocks are then added. Baskets above ``wide`` items would fill whole tiles; they stay out of these
sums and are handled exactly: each item carries the list of its wide baskets, whose intersection is
added to the pairs at hand, and pairs that only wide baskets can make frequent come from dense
tiles over blocks of the items that lie in enough wide baskets.

Defined results: null baskets, items and ratings do not count; repeated rows count once; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.operators import stats
from tastegrid.plans.scratch import collect_if_small, cut, ship_package

#: Largest basket that enters the sparse products; every larger one takes the dense way.
WIDE = 512
#: Items per side of a dense tile.
TILE = 2048
_HELD_PAIRS = 4_000_000


def _sum_pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    begin = np.concatenate(([0], edge))
    n = np.diff(np.concatenate((begin, [len(a)])))
    return pa.record_batch([pa.array(a[begin]), pa.array(b[begin]), pa.array(n.astype(np.int64))], names=["a", "b", "n"])


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transpose-products of record blocks; ``items`` of a record are distinct."""
    held, size = [], 0
    for batch in batches:
        lists = batch.column(0)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        length = np.diff(offsets)
        for n in np.unique(length[length > 1]):
            start = offsets[:-1][length == n]
            left, right = np.triu_indices(int(n), 1)
            step = max(1, 2_000_000 // len(left))
            for i in range(0, len(start), step):
                block = np.sort(values[start[i : i + step, None] + np.arange(n)], axis=1)
                held.append((block[:, left].ravel(), block[:, right].ravel()))
                size += held[-1][0].size
                if size >= _HELD_PAIRS:
                    yield _sum_pairs(held)
                    held, size = [], 0
    if held:
        yield _sum_pairs(held)


def _tile(least: int) -> Callable:
    """Dense product of two item blocks over their wide baskets; pairs in at least ``least`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.array(r[f"items_{s}"], np.int64) for s in "xy"]
                owners = [[np.array(w, np.int64) for w in r[f"wide_{s}"]] for s in "xy"]
                used = np.unique(np.concatenate([w for side in owners for w in side]))
                total = np.zeros((len(ids[0]), len(ids[1])), np.float32)
                for c in range(0, len(used), 4096):
                    part = used[c : c + 4096]
                    sides = []
                    for side in owners:
                        m = np.zeros((len(side), len(part)), np.float32)
                        for i, w in enumerate(side):
                            at = np.searchsorted(part, w)
                            ok = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == w)
                            m[i, at[ok]] = 1
                        sides.append(m)
                    total += sides[0] @ sides[1].T
                x, y = np.nonzero(total >= least)
                a, b = ids[0][x], ids[1][y]
                keep = a < b if r["x"] == r["y"] else a != b
                a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _block(least: int) -> Callable:
    schema = pa.schema([("block", pa.int64()), ("items", pa.list_(pa.int64())), ("wide", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, wide = [], []

        def out() -> pa.RecordBatch:
            name = int(items[0])
            return pa.record_batch([pa.array([name]), pa.array([items], pa.list_(pa.int64())), pa.array([wide], pa.list_(pa.list_(pa.int64())))], schema=schema)

        for batch in batches:
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items.append(i)
                wide.append(sorted(w))
                if len(items) == TILE:
                    yield out()
                    items, wide = [], []
        if items:
            yield out()

    return run


def cooccurrence(records: DataFrame, basket: Column, item: Column, *, min_count: int = 4, min_lift: int = 5, wide: int = WIDE) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift) of pairs in at least ``min_count`` baskets with lift of at least ``min_lift``.

    item_a < item_b byte by byte; lift = n_ab * n_baskets / (n_a * n_b), compared in whole numbers.
    """
    spark = records.sparkSession
    ship_package(spark)
    pairs = records.select(basket.cast("string").alias("basket"), item.cast("string").alias("item")).where("basket is not null and item is not null").distinct()
    rows = cut(pairs)
    sizes = cut(rows.groupBy("basket").agg(F.count("*").alias("size")))
    n_baskets = sizes.count()
    marginal = rows.groupBy("item").agg(F.count("*").alias("n"))
    # n_ab <= min(n_a, n_b): too rare items and those in over n_baskets/min_lift baskets are in no result
    kept = cut(marginal.where((F.col("n") >= min_count) & (F.col("n") * min_lift <= n_baskets)).withColumn("i", F.monotonically_increasing_id()))
    hot = collect_if_small(marginal.where(F.col("n") * min_lift > n_baskets).select("item"), 1000)
    usable = rows.where(~F.col("item").isin([r.item for r in hot])) if hot else rows
    coded = usable.join(kept.select("item", "i"), "item").select("basket", "i")
    large = sizes.where(F.col("size") > wide).withColumn("w", F.monotonically_increasing_id()).select("basket", "w")
    large = cut(large)
    named = collect_if_small(large, 10_000)
    few = F.broadcast(large) if named is not None else large
    narrow = coded.join(few, "basket", "left_anti") if named is None or named else coded
    lists = narrow.groupBy("basket").agg(F.collect_list("i").alias("items")).where(F.size("items") > 1).select("items")
    counted = lists.mapInArrow(_gram, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_narrow"))
    n_wide = large.count()
    if n_wide:
        owned = cut(coded.join(few, "basket").groupBy("i").agg(F.collect_list("w").alias("wide")))
        counted = counted.where(F.col("n_narrow") >= max(1, min_count - n_wide))
        if n_wide >= min_count:
            blocks = cut(owned.where(F.size("wide") >= min_count).select("i", "wide").mapInArrow(_block(min_count), "block long, items array<long>, wide array<array<long>>"))
            # blocks are numbered, one number per TILE items; one tile per unordered pair of blocks, reached by an equi-join
            numbers = stats.ranked_globally(blocks.select("block"), [F.col("block")], "number").select("block", F.col("number").cast("int").alias("number"))
            numbered = cut(blocks.join(numbers, "block").select("number", "items", "wide"))
            x, y = numbered.toDF("x", "items_x", "wide_x"), numbered.toDF("y", "items_y", "wide_y")
            tiles = x.withColumn("y", F.explode(F.sequence("x", F.lit(numbered.count())))).join(y, "y")
            dense = tiles.mapInArrow(_tile(min_count), "a long, b long").withColumn("n_narrow", F.lit(0).cast("long"))
            counted = counted.unionByName(dense).groupBy("a", "b").agg(F.sum("n_narrow").alias("n_narrow"))
    else:
        owned = None
        counted = counted.where(F.col("n_narrow") >= min_count)
    a, b = kept.toDF("item_x", "n_x", "a"), kept.toDF("item_y", "n_y", "b")
    if owned is not None:
        a = a.join(owned.toDF("a", "wide_x"), "a", "left")
        b = b.join(owned.toDF("b", "wide_y"), "b", "left")
    both = counted.join(a, "a").join(b, "b")
    extra = F.coalesce(F.size(F.array_intersect("wide_x", "wide_y")), F.lit(0)) if owned is not None else F.lit(0)
    both = both.withColumn("n_ab", F.col("n_narrow") + F.greatest(extra, F.lit(0)))
    both = both.where((F.col("n_ab") >= min_count) & (F.col("n_ab") * n_baskets >= min_lift * F.col("n_x") * F.col("n_y")))
    first = F.col("item_x") < F.col("item_y")
    return both.select(
        F.least("item_x", "item_y").alias("item_a"),
        F.greatest("item_x", "item_y").alias("item_b"),
        "n_ab",
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"),
        F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"),
        F.lit(n_baskets).cast("long").alias("n_baskets"),
        (F.col("n_ab") * F.lit(n_baskets) / (F.col("n_x") * F.col("n_y"))).alias("lift"),
    )
