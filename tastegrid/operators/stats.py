"""Descriptive and rating statistics.

Means of an empty group do not exist; a group of one has standard deviation 0. All aggregates are algebraic
and combine map-side, so hot users and items do not gather in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.plans.scratch import cut


def _std(rating: Column) -> Column:
    return F.when(F.count(rating) < 2, 0.0).otherwise(F.stddev_pop(rating))


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rating_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: n, mean, std, share of ratings from 4, share of ratings up to 2."""
    r = F.col("rating")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), _std(r).alias("std"), _share(r >= 4).alias("positive_share"), _share(r <= 2).alias("negative_share"))


def recent_means(rows: DataFrame, n: int = 3) -> DataFrame:
    """(user_id, recent_mean): mean of each user's ``n`` latest ratings."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("review_id")))
    return rows.withColumn("back", back).where(F.col("back") <= n).groupBy("user_id").agg(F.avg("rating").alias("recent_mean"))


def item_rollup(rows: DataFrame) -> DataFrame:
    """(item_id, n, mean, name, category): first name and category by time, as the catalogue of a raw log."""
    return rows.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.min(F.struct("ts", "review_id", "name", "category")).alias("f")).select("item_id", "n", "mean", F.col("f.name").alias("name"), F.col("f.category").alias("category"))


def popularity(rows: DataFrame, item_ids: DataFrame, positive_only: bool) -> DataFrame:
    """(item_id, n, rank): interactions per catalogue item, most popular first, ties to the greater id."""
    used = rows.where("rating >= 4") if positive_only else rows
    counts = used.groupBy("item_id").agg(F.count("*").alias("n"))
    full = item_ids.select("item_id").distinct().join(counts, "item_id", "left").na.fill(0, ["n"])
    return ranked_globally(full, [F.desc("n"), F.desc("item_id")])


def ranked_globally(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based rank in a total order without a single-task window: range partitions, then chained sizes."""
    spread = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    fixed = cut(spread.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    sizes = fixed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return fixed.join(F.broadcast(before.select("part", "base")), "part").withColumn(name, F.col("base") + F.col("within")).drop("part", "within", "base")


#: Rows of a user from which they are combined on the map side instead of being gathered.
MANY_ROWS = 2000


def within_users(rows: DataFrame, f: Callable[[DataFrame], DataFrame], many: int = MANY_ROWS, heavy: Callable[[DataFrame], DataFrame] | None = None, key: str = "user_id") -> DataFrame:
    """``f(rows)`` for an ``f`` whose results each come from the rows of one ``key``.

    Rows are gathered by key first, so what ``f`` explodes is aggregated where it arises and only the rows are shuffled. The keys with more than
    ``many`` rows keep the aggregation in two steps, which shrinks theirs before the shuffle; with ``heavy``, that is what they get in place of ``f``.
    """
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > many).select(key))
    light = rows.join(hot, key, "left_anti").repartition(key)
    return f(light).unionByName((heavy or f)(rows.join(hot, key, "left_semi")))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """n, min, mean, max and p50, p90, p95, p99 by nearest rank; an empty column gives nulls and n = 0."""
    at = [F.expr(f"percentile_disc({p}) within group (order by v)").alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    return rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), *at)


def dataset_summary(rows: DataFrame) -> DataFrame:
    """One row: reviews, distinct users, items and pairs, sparse users, rating histogram, time range, density."""
    pairs = rows.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), *(F.sum((F.round("rating") == s).cast("long")).alias(f"stars_{s}") for s in range(1, 6)))
    users = pairs.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("pairs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.sum(f"stars_{s}").alias(f"stars_{s}") for s in range(1, 6)))
    by_user = users.agg(F.sum("n").alias("n_reviews"), F.count("*").alias("n_users"), F.sum("pairs").alias("n_pairs"), F.sum((F.col("n") <= 2).cast("long")).alias("n_sparse_users"), F.min("lo").alias("min_ts"), F.max("hi").alias("max_ts"), *(F.sum(f"stars_{s}").alias(f"stars_{s}") for s in range(1, 6)))
    by_item = pairs.select("item_id").distinct().agg(F.count("*").alias("n_items"))
    one = F.lit(1)
    return by_user.withColumn("k", one).join(by_item.withColumn("k", one), "k").drop("k").withColumn("density", F.round(F.col("n_pairs") / (F.col("n_users") * F.col("n_items")), 8))
