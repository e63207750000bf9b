"""File sources and sinks of the engine: JSON lines with several historical schemas, CSV, Markdown tables, index tables.

Schemas are fixed, never inferred. Compressed files are recognised by their suffix. Malformed lines are dropped
where a function says so; a missing path is an empty table where a function says so.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

REVIEW = "review_id string, user_id string, item_id string, item_name string, rating double, review string, category string, timestamp long"
ITEM = "item_id string, name string, category string, metadata map<string,string>, summary string, average_rating double"

# The columns under which each field is found in raw feeds, first match first.
FEEDS = {
    "amazon": {
        "user_id": ("user_id", "reviewerID"),
        "item_id": ("parent_asin", "asin", "item_id"),
        "timestamp": ("timestamp", "unixReviewTime"),
        "item_name": ("title", "item_name"),
        "review": ("text", "reviewText", "review"),
        "rating": ("rating", "overall"),
        "category": ("category",),
    },
    "yelp": {
        "user_id": ("user_id", "reviewer_id"),
        "item_id": ("business_id", "item_id"),
        "timestamp": ("date", "timestamp"),
        "item_name": ("name", "business_name"),
        "review": ("text", "review"),
        "rating": ("stars", "rating", "label"),
        "category": ("categories", "category"),
    },
}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, missing_ok: bool = True, tolerant: bool = True) -> DataFrame:
    """JSON lines; blank and, if ``tolerant``, malformed lines are dropped; a missing path is empty if ``missing_ok``."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _first(columns: Sequence[str]) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def _seconds(value: Column) -> Column:
    """Epoch number, or the date in the first ten characters; 0 otherwise."""
    return F.coalesce(value.try_cast("long"), F.unix_timestamp(F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))), F.lit(0))


def read_feed(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Raw reviews of a feed as ``REVIEW`` rows without ``review_id``: coalesced over its schema variants, valid rows only.

    A row is valid with a user, an item, a text and a rating of 1 to 5. Missing names are the item id, categories ``unknown``.
    """
    fields = FEEDS[feed]
    names = list(dict.fromkeys(c for group in fields.values() for c in group))
    raw = read_jsonl(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    rows = raw.select(
        _first(fields["user_id"]).alias("user_id"),
        _first(fields["item_id"]).alias("item_id"),
        F.coalesce(_first(fields["item_name"]), _first(fields["item_id"])).alias("item_name"),
        _first(fields["rating"]).try_cast("double").alias("rating"),
        F.trim(_first(fields["review"])).alias("review"),
        F.coalesce(_categories(_first(fields["category"])), F.lit("unknown")).alias("category"),
        _seconds(_first(fields["timestamp"])).alias("timestamp"),
    )
    return rows.where("user_id is not null and item_id is not null and review <> '' and rating between 1 and 5")


def _categories(value: Column) -> Column:
    """A list of categories as one string with commas; a plain string as it is."""
    return F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(value)


def stable_review_id(user: Column, item: Column, ts: Column, index: Column) -> Column:
    return F.concat_ws(":", user, item, ts.cast("string"), index.cast("string"))


def combine(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of catalogues in order; the first table that has a key wins."""
    union = None
    for i, t in enumerate(tables):
        part = t.withColumn("_order", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    columns = [c for c in union.columns if c not in (key, "_order")]
    first = union.groupBy(key).agg(F.min_by(F.struct(*columns), "_order").alias("f"))
    return first.select(key, *(F.col(f"f.{c}").alias(c) for c in columns))


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header as strings; UTF-8 if the bytes are valid, else ISO-8859-1 (the superset of it that
    Windows writes differs only in punctuation between 0x80 and 0x9f)."""
    head = spark.read.format("binaryFile").load(path).select("content")
    valid = head.select(F.min(F.is_valid_utf8("content").cast("int"))).first()[0]
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8" if valid else "ISO-8859-1").csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿")) if df.columns else df


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells) of the pipe-table rows of Markdown files: ``\\|`` is a bar, ``<br>`` a line break; rulers are left out."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("line", F.monotonically_increasing_id())
    inner = F.regexp_replace(F.trim("value"), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\\\|", "|"), r"<br\s*/?>", "\n")))
    return lines.where(r"trim(value) like '|%'").where(~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).select("file", "line", cells.alias("cells"))


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def write_report(report: dict, path: str) -> None:
    """One small report as JSON, written whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
    os.replace(part, path)


def write_neighbors(df: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Neighbour table bucketed by item and sorted by rank, so lookups and joins on the item need no exchange; at ``path`` where given."""
    writer = df.write.mode("overwrite").bucketBy(buckets, "item_id").sortBy("item_id", "rank")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def file_status(path: str, expected: int | None) -> str:
    """missing, partial:<have>/<want>, complete, oversized:<have>/<want> or present_unverified."""
    if not os.path.exists(path):
        return "missing"
    have = os.path.getsize(path)
    if expected is None:
        return "present_unverified"
    if have == expected:
        return "complete"
    return f"{'partial' if have < expected else 'oversized'}:{have}/{expected}"
