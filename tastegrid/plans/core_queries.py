"""Queries of the general (non-llm) operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.operators import heavy_keys


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of item_id and user_id that hold at least 3 % of all delivered rows of reviews."""
    return heavy_keys.heavy(spark.read.parquet(f"{sf_dir}/reviews.parquet"), ("item_id", "user_id"), 3).select("key_field", "key_value")


def p7_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct partners and mean rating of every item and every user of reviews."""
    done = heavy_keys.per_key(spark.read.parquet(f"{sf_dir}/reviews.parquet"), "item_id", "user_id", "rating")
    return done.withColumn("mean_value", F.round("mean_value", 6))


QUERIES = {"p7_found": p7_found, "p7_keys": p7_keys}

SQL = {
    "p7_found": """
        SELECT 'item_id' AS key_field, item_id AS key_value FROM reviews WHERE item_id IS NOT NULL
        GROUP BY item_id HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM reviews)
        UNION ALL
        SELECT 'user_id', user_id FROM reviews WHERE user_id IS NOT NULL
        GROUP BY user_id HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM reviews)""",
    "p7_keys": """
        SELECT 'item_id' AS key_field, item_id AS key_value, count(*) AS n_rows, count(DISTINCT user_id) AS n_partners,
               round(avg(rating) FILTER (NOT isnan(rating)), 6) AS mean_value
        FROM reviews WHERE item_id IS NOT NULL GROUP BY item_id
        UNION ALL
        SELECT 'user_id', user_id, count(*), count(DISTINCT item_id), round(avg(rating) FILTER (NOT isnan(rating)), 6)
        FROM reviews WHERE user_id IS NOT NULL GROUP BY user_id""",
}
