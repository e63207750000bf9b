"""User and item profiles as one row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions import text as T
from tastegrid.functions.words import PROFILE_STOPWORDS
from tastegrid.operators import indexes, retrieval, stats, tokens
from tastegrid.plans.scratch import ship_package


def words_in(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def user_numbers(rows: DataFrame) -> DataFrame:
    """Averages, spread, shares, trend, review length, voice, strictness and confidence of every user."""
    order = Window.partitionBy("user_id").orderBy("ts", "review_id")
    whole = Window.partitionBy("user_id")
    placed = rows.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(whole)).withColumn("late", F.col("i") > F.floor(F.col("n") / 2))
    base = placed.groupBy("user_id").agg(
        F.count("*").alias("evidence_count"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
        F.avg("rating").alias("mean"),
        F.round(F.avg(F.when(F.col("i") > F.col("n") - 3, F.col("rating"))), 2).alias("recent_average_rating"),
        F.round(F.when(F.count("rating") < 2, 0.0).otherwise(F.stddev_pop("rating")), 3).alias("rating_std"),
        F.round(F.avg(F.when(F.col("rating") >= 4, 1.0).otherwise(0.0)), 3).alias("positive_rating_share"),
        F.round(F.avg(F.when(F.col("rating") <= 2, 1.0).otherwise(0.0)), 3).alias("negative_rating_share"),
        F.round(F.when(F.count("*") < 4, 0.0).otherwise(F.avg(F.when(F.col("late"), F.col("rating"))) - F.avg(F.when(~F.col("late"), F.col("rating")))), 3).alias("rating_trend"),
        F.avg(words_in(F.col("review"))).alias("words"),
        F.countDistinct(F.bround("rating", 0)).alias("stars"),
    )
    strict = F.when(F.col("mean") < 3.2, "strict").when(F.col("mean") > 4.1, "generous").otherwise("balanced")
    voice = F.when(F.col("words") < 20, "short, direct, and practical").when(F.col("words") > 80, "detailed and experience-driven").otherwise("balanced, specific, and conversational")
    sure = F.round(F.least(0.10 + F.least(F.col("evidence_count") / 8, F.lit(0.75)) + F.when(F.col("stars") > 1, 0.10).otherwise(0.0), F.lit(0.95)), 3)
    return base.select("user_id", "evidence_count", "average_rating", "recent_average_rating", "rating_std", "positive_rating_share", "negative_rating_share", "rating_trend", F.round("words", 2).alias("review_length_mean"), strict.alias("rating_strictness"), voice.alias("voice_style"), sure.alias("confidence"))


def top_terms(rows: DataFrame, most: int = 8) -> DataFrame:
    """(user_id, mood, term, n, rank): frequent terms of liked (4 and up) and disliked (2 and below) reviews; ties by term."""
    mood = F.when(F.col("rating") >= 4, "liked").when(F.col("rating") <= 2, "disliked")
    ship_package(rows.sparkSession)

    def counted(part: DataFrame) -> DataFrame:
        said = part.sortWithinPartitions("user_id").select("user_id", "mood", T.join_parts(F.col("review"), F.col("name"), F.col("category")))
        return said.mapInArrow(tokens.best_words(most, PROFILE_STOPWORDS), "user_id string, mood string, term string, n long, rank int")

    def spread(part: DataFrame) -> DataFrame:
        words = T.without(T.terms(T.join_parts(F.col("review"), F.col("name"), F.col("category"))), PROFILE_STOPWORDS)
        counts = part.select("user_id", "mood", F.explode(words).alias("term")).groupBy("user_id", "mood", "term").agg(F.count("*").alias("n"))
        return indexes.top(counts, ["user_id", "mood"], [F.desc("n"), "term"], most)

    return stats.within_users(rows.withColumn("mood", mood).where("mood is not null").select("user_id", "mood", "review", "name", "category"), counted, heavy=spread)


def category_affinity(rows: DataFrame) -> DataFrame:
    """(user_id, category, affinity): (mean - 3) / 2, three places."""
    return rows.groupBy("user_id", "category").agg(F.round((F.avg("rating") - 3) / 2, 3).alias("affinity"))


def hashed_vectors(tokens: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, slot, value) of the unit vector of hashed term counts, weight 1 + ln(count); zero slots have no row."""
    counts = tokens.groupBy(key, "term").agg(F.count("*").alias("n"))
    slots = counts.groupBy(key, T.hashed_slot(F.col("term"), size).alias("slot")).agg(F.sum(T.hashed_sign(F.col("term")) * (1 + F.log("n"))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return slots.withColumn("norm", norm).where("norm > 0").select(key, "slot", F.round(F.col("v") / F.col("norm"), 6).alias("value")).where("value <> 0")


def item_profiles(items: DataFrame) -> DataFrame:
    """(item_id, category, quality_score, popularity, terms): quality clip((rating-1)/4), first 32 distinct terms."""
    quality = F.coalesce(F.least(F.greatest((F.col("average_rating") - 1) / 4, F.lit(0.0)), F.lit(1.0)), F.lit(0.65))
    return items.select("item_id", "category", F.round(quality, 6).alias("quality_score"), "popularity", F.slice(F.array_distinct(T.terms(indexes.item_text(keys=False))), 1, 32).alias("terms"))


def user_profiles(rows: DataFrame) -> DataFrame:
    """Numbers, preferred categories and liked and disliked terms in one row per user."""
    categories = retrieval.preferred_categories(rows).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category"))), lambda x: x["category"]).alias("preferred_categories"))
    terms = top_terms(rows).groupBy("user_id").pivot("mood", ["liked", "disliked"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]))
    return user_numbers(rows).join(categories, "user_id", "left").join(terms.toDF("user_id", "preferred_terms", "disliked_terms"), "user_id", "left")


