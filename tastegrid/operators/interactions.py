"""Interaction, item and history views over dirty review logs, and temporal splits.

Defined results: rows without user, item, text or a rating of 1 to 5 are no interactions; repeated
deliveries of a review id are one; a missing category is ``unknown``, a missing name the item id, a missing time 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions.text import one_spelling
from tastegrid.plans.scratch import cut

#: Epoch values from here on are milliseconds.
MILLIS_FROM = 100_000_000_000


def category_of(column: Column) -> Column:
    return F.coalesce(F.nullif(one_spelling(column), F.lit("")), F.lit("unknown"))


def interactions(reviews: DataFrame) -> DataFrame:
    """(review_id, user_id, item_id, name, rating, review, category, ts) of the valid reviews, each once."""
    valid = reviews.where("user_id <> '' and item_id <> '' and trim(review) <> '' and rating >= 1 and rating <= 5")
    seconds = F.when(F.col("timestamp") >= MILLIS_FROM, F.expr("timestamp div 1000")).otherwise(F.coalesce("timestamp", F.lit(0)))
    return valid.select("review_id", "user_id", "item_id", F.coalesce(F.nullif("item_name", F.lit("")), "item_id").alias("name"), "rating", "review", category_of(F.col("category")).alias("category"), seconds.alias("ts")).dropDuplicates(["review_id"])


def items(table: DataFrame) -> DataFrame:
    """(item_id, name, category, metadata, summary, average_rating, popularity) of the catalogue, each item once."""
    popular = F.coalesce(F.nullif(F.try_to_number(F.element_at("metadata", "rating_number"), F.lit("999999999")), F.lit(0)), F.try_to_number(F.element_at("metadata", "review_count"), F.lit("999999999")), F.lit(0))
    one = table.where("item_id <> ''").dropDuplicates(["item_id"])
    return one.select("item_id", F.coalesce("name", "item_id").alias("name"), category_of(F.col("category")).alias("category"), "metadata", F.coalesce("summary", F.lit("")).alias("summary"), F.when(~F.isnan("average_rating"), F.col("average_rating")).alias("average_rating"), popular.cast("long").alias("popularity"))


def temporal_split(rows: DataFrame, min_history: int = 1) -> DataFrame:
    """``rows`` with ``is_test``: the last interaction of each user with more than ``min_history`` of them.

    The last row and the number of rows of a user are map-side combined and joined back, so a user with a large share of all
    rows is never gathered in one task.
    """
    return with_split(rows, min_history).drop("has_test")


def with_split(rows: DataFrame, min_history: int = 1) -> DataFrame:
    """``rows`` with ``is_test`` and ``has_test``: whether the user has a test row."""
    users = rows.groupBy("user_id").agg(F.count("*").alias("n_user"), F.max(F.struct("ts", "review_id")).alias("last"))
    more = F.col("n_user") > min_history
    marked = rows.join(users, "user_id").withColumns({"is_test": more & (F.struct("ts", "review_id") == F.col("last")), "has_test": more})
    return marked.select(*rows.columns, "is_test", "has_test")


def train_of(rows: DataFrame) -> DataFrame:
    return temporal_split(rows).where("not is_test").drop("is_test")


def test_of(rows: DataFrame) -> DataFrame:
    return temporal_split(rows).where("is_test").drop("is_test")


def stride_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows at ordinals min(int(i*N/n), N-1) for i < n over the total order, evenly spread."""
    total = rows.count()
    if not total:
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    wanted = rows.sparkSession.range(min(n, total)).select(F.least(F.floor(F.col("id") * total / min(n, total)), F.lit(total - 1)).alias("ordinal")).distinct()
    return ordinals(rows, order).join(wanted, "ordinal")


def ordinals(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with 0-based ``ordinal`` in the total order; range-partitioned, no single-task window over rows."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fixed = cut(sorted_rows.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    sizes = fixed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return fixed.join(F.broadcast(before.select("part", "base")), "part").withColumn("ordinal", F.col("base") + F.col("within") - 1).drop("part", "within", "base")


def shard(rows: DataFrame, order: list[str], count: int, index: int) -> DataFrame:
    """Every ``count``-th row of the total order, beginning with ``index``."""
    if count < 1 or not 0 <= index < count:
        raise ValueError("shard index must lie within the shard count")
    return ordinals(rows, order).where(F.col("ordinal") % count == index)


def history_bucket(n: Column) -> Column:
    """Evaluation bucket by history size: sparse up to 2, medium up to 7, else warm."""
    return F.when(n <= 2, "sparse").when(n <= 7, "medium").otherwise("warm")


def rating_bucket(n: Column) -> Column:
    """Rating-task bucket by history size: cold 0, light up to 2, medium up to 9, else warm."""
    return F.when(n <= 0, "cold").when(n <= 2, "light").when(n <= 9, "medium").otherwise("warm")
