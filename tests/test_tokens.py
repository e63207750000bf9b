"""Words counted inside the task are those of the column expressions."""

from pyspark.sql import functions as F

from tastegrid.functions import text as T
from tastegrid.functions.words import REVIEW_STOPWORDS
from tastegrid.operators import indexes, profiles, stats, tokens
from tests.test_operators import rows_of

ODD = ["", "12 oz x1  inch abc12 ml a-b_c", "Ünïté İstanbul Kelvin word WORD word", "about good 5\tpack 7count count the-the the-the", "ab abc a1b2 -abc _abc zz9"]


def test_words_equal_the_expressions(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    for r in frame.select("t", T.terms(F.col("t")).alias("a"), T.review_terms(F.col("t")).alias("b")).collect():
        assert tokens.terms(r["t"]) == r["a"] and tokens.review_terms(r["t"], frozenset(REVIEW_STOPWORDS)) == r["b"]


def _rows(spark):
    return rows_of(spark, [(f"u{u}", f"i{k % 3}", 5 if (u + k) % 3 else 1, "cat_a", 10 * u + k) for u in range(4) for k in range(5)]).withColumn("review", F.concat(F.lit("word second third12 inch w"), F.col("ts").cast("string"), F.lit("ord tail")))


def test_terms_of_profiles_are_counted_in_the_task(spark, monkeypatch):
    """every word of every review was a row of its own (r13_bm25 and the pool)."""
    found = profiles.top_terms(_rows(spark), 3)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(stats.within_users, "__defaults__", (1, None, "user_id"))
    assert whole and sorted(map(tuple, profiles.top_terms(_rows(spark), 3).collect())) == whole


def test_index_terms_do_not_depend_on_the_path(spark, monkeypatch):
    """the index of review terms hashed every word of every review as a row."""
    items = spark.createDataFrame([(f"i{k}", f"name{k} thing", "cat_a", {"size": "12 oz"}, "plain words") for k in range(4)], "item_id string, name string, category string, metadata map<string,string>, summary string")
    whole = sorted(map(tuple, indexes.review_term_index(_rows(spark), items).collect()))
    monkeypatch.setattr(stats.within_users, "__defaults__", (0, None, "user_id"))
    assert whole and sorted(map(tuple, indexes.review_term_index(_rows(spark), items).collect())) == whole
