"""File sources and streams on small files."""

import json

from pyspark.sql import functions as F

from tastegrid.sources import files
from tastegrid.streaming import live


def test_feeds_coalesce_their_variants(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    rows = [{"reviewerID": "u", "asin": "i", "overall": 4, "reviewText": " good ", "unixReviewTime": 5}, {"user_id": "v", "parent_asin": "j", "rating": "5.0", "text": "x", "title": "T"}, {"user_id": "w", "asin": "k", "rating": 9, "text": "x"}, {"user_id": "", "asin": "k", "rating": 4, "text": "x"}]
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    got = {r["user_id"]: r for r in files.read_feed(spark, str(path), "amazon").collect()}
    assert set(got) == {"u", "v"} and got["u"]["review"] == "good" and got["u"]["timestamp"] == 5 and got["u"]["item_name"] == "i" and got["v"]["item_name"] == "T"
    yelp = tmp_path / "y.jsonl"
    yelp.write_text(json.dumps({"user_id": "u", "business_id": "b", "stars": 3, "text": "t", "date": "1970-01-02 10:00:00", "categories": ["A", "B"]}) + "\n")
    r = files.read_feed(spark, str(yelp), "yelp").first()
    assert (r["timestamp"], r["category"], r["rating"]) == (86400, "A, B", 3.0)
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), files.REVIEW).count() == 0


def test_combine_keeps_the_first(spark):
    a, b = spark.createDataFrame([("x", "a")], "item_id string, name string"), spark.createDataFrame([("x", "b"), ("y", "b")], "item_id string, name string")
    assert {tuple(r) for r in files.combine([a, b], "item_id").collect()} == {("x", "a"), ("y", "b")}


def test_csv_and_markdown(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,notes\nÉva,\"a,b\"\n".encode("cp1252"))
    assert tuple(files.read_csv_any_encoding(spark, str(tmp_path / "l.csv")).first()) == ("Éva", "a,b")
    (tmp_path / "u.csv").write_bytes("﻿name\nÉva\n".encode())
    assert tuple(files.read_csv_any_encoding(spark, str(tmp_path / "u.csv")).first()) == ("Éva",)
    (tmp_path / "t.md").write_text("# T\n| a | b |\n|---|:-:|\n| x \\| y | l<br>m |\n")
    assert [r["cells"] for r in files.read_markdown_table(spark, str(tmp_path / "t.md")).orderBy("line").collect()] == [["a", "b"], ["x | y", "l\nm"]]


def test_status_and_report(tmp_path):
    f = tmp_path / "f"
    assert files.file_status(str(f), 4) == "missing"
    f.write_bytes(b"ab")
    assert files.file_status(str(f), 4) == "partial:2/4" and files.file_status(str(f), 2) == "complete" and files.file_status(str(f), None) == "present_unverified"
    files.write_report({"a": 1}, str(tmp_path / "d" / "r.json"))
    assert json.loads((tmp_path / "d" / "r.json").read_text()) == {"a": 1}


def test_rate_limit_batch_equals_stream(spark, tmp_path):
    rows = [("k", 0.0), ("k", 10.0), ("k", 20.0), ("k", 61.0), ("k", 62.0), ("z", 5.0)]
    df = spark.createDataFrame(rows, "key string, ts double")
    want = {("k", 0.0, True), ("k", 10.0, True), ("k", 20.0, False), ("k", 61.0, True), ("k", 62.0, False), ("z", 5.0, True)}
    assert {tuple(r) for r in live.rate_limit(df, 2, 60).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.rate_limit(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("limited").collect()} == want


def test_stream_counts_each_review_once(spark, tmp_path):
    rows = [("a", 5.0, "2024-01-01 00:00:00"), ("a", 5.0, "2024-01-01 01:00:00"), ("b", 3.0, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "review_id string, rating double, t string").select("review_id", "rating", F.to_timestamp("t").alias("ingested_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.once(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["review_id"] for r in spark.table("once").collect()) == ["a", "b"]
    assert {(r["n"], r["mean"]) for r in live.windowed_counts(df, "1 day", "1 day").collect()} == {(3, (5.0 + 5.0 + 3.0) / 3)}
