"""Offline retrieval indexes over training interactions, each a long-form table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions import text as T
from tastegrid.functions.words import ASPECT_STOPWORDS, ASPECTS, REVIEW_STOPWORDS
from tastegrid.operators import gram, stats, tokens
from tastegrid.plans.scratch import cut, ship_package, write_table

#: Latest items of a user that enter co-visitation; bounds the pairs per user.
MAX_ITEMS_PER_USER = 50


def interaction_weight(rating: Column, threshold: float = 4.0, weighted: bool = False) -> Column:
    """0 below the threshold; else 1, or the rating share clamped to [0.15, 1]."""
    kept = F.greatest(F.least(rating / 5.0, F.lit(1.0)), F.lit(0.15)) if weighted else F.lit(1.0)
    return F.when(rating >= threshold, kept).otherwise(0.0)


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the filter on the rank lets Spark cut groups before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def latest_positive(train: DataFrame, threshold: float = 4.0, weighted: bool = False) -> DataFrame:
    """One row per user and item: the latest positive interaction, with its weight."""
    positive = train.withColumn("weight", interaction_weight(F.col("rating"), threshold, weighted)).where("weight > 0")
    return positive.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "review_id", "rating", "weight", "category")).alias("m")).select("user_id", "item_id", F.col("m.ts").alias("ts"), F.col("m.rating").alias("rating"), F.col("m.weight").alias("weight"), F.col("m.category").alias("category"))


def covisitation(train: DataFrame, k: int = 20, threshold: float = 4.0, weighted: bool = False, per_user: int = MAX_ITEMS_PER_USER) -> DataFrame:
    """(item_id, neighbor_id, score, rank): co-liked items, sum of sqrt(w_l*w_r) over sqrt(W_l*W_r).

    A user's items (at most ``per_user``) are multiplied as numbers, each unordered pair once.
    """
    liked = latest_positive(train, threshold, weighted)
    totals = liked.groupBy("item_id").agg(F.sum("weight").alias("total"))
    capped = top(liked, ["user_id"], [F.desc("ts"), F.desc("item_id")], per_user)
    number = cut(stats.ranked_globally(totals, [F.col("item_id")], "i").select("item_id", "i", "total"))
    cells = capped.join(number.select("item_id", "i"), "item_id").select("user_id", "i", F.sqrt("weight").alias("w"))
    co = gram.pair_sums(cells, "user_id", "i", "w")
    x, y = number.toDF("item_id", "a", "total"), number.toDF("neighbor_id", "b", "other")
    one = co.join(x, "a").join(y, "b").select("item_id", "neighbor_id", F.round(F.col("dot") / F.sqrt(F.col("total") * F.col("other")), 4).alias("score"))
    scored = one.unionByName(one.select(F.col("neighbor_id").alias("item_id"), F.col("item_id").alias("neighbor_id"), "score"))
    return top(scored, ["item_id"], [F.desc("score"), "neighbor_id"], k)


def user_positive_items(train: DataFrame, per_user: int = MAX_ITEMS_PER_USER, threshold: float = 4.0) -> DataFrame:
    """(user_id, item_id, rating, weight, ts, category, rank): a user's best-rated, latest items."""
    return top(latest_positive(train, threshold), ["user_id"], [F.desc("rating"), F.desc("ts"), F.desc("item_id")], per_user)


def item_positive_users(train: DataFrame, per_item: int = 500, **kwargs) -> DataFrame:
    """(item_id, user_id, rating, weight, ts, rank): users of an item by rating, time and id."""
    return top(user_positive_items(train, **kwargs).drop("rank", "category"), ["item_id"], [F.desc("rating"), F.desc("ts"), F.desc("user_id")], per_item)


def item_text(keys: bool = True) -> Column:
    """Name, category, summary and metadata of a catalogue row as one text."""
    return T.join_parts(F.col("name"), F.col("category"), F.col("summary"), T.map_text(F.col("metadata"), keys))


def review_term_index(train: DataFrame, items: DataFrame, per_item: int = 18) -> DataFrame:
    """(item_id, term, score, rank, posting): the best terms of each item and their posting score."""
    about = items.select("item_id", F.lit(1.25).alias("w"), item_text().alias("text"))
    positive = train.where("rating >= 4")
    said = positive.select("item_id", F.lit(2.0).alias("w"), T.join_parts(F.col("name"), F.col("category"), F.col("review")).alias("text"))
    ship_package(train.sparkSession)

    def counted(part: DataFrame) -> DataFrame:
        return part.sortWithinPartitions("item_id").select("item_id", "w", "text").mapInArrow(tokens.summed_words(REVIEW_STOPWORDS), "item_id string, term string, tf double")

    def spread(part: DataFrame) -> DataFrame:
        return part.select("item_id", "w", F.explode(T.review_terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.sum("w").alias("tf"))

    counts = train.sparkSession.read.parquet(write_table(stats.within_users(about.unionByName(said), counted, heavy=spread, key="item_id"), "terms", compression="zstd"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = counts.select("item_id").distinct().count()
    scored = counts.join(df, "term").select("item_id", "term", F.round((1 + F.log("tf")) * F.log(1 + F.lit(float(max(n, 1))) / (1 + F.col("df"))), 4).alias("score"))
    best = top(scored, ["item_id"], [F.desc("score"), "term"], per_item).where("score > 0")
    popular = positive.groupBy("item_id").agg(F.count("*").alias("positive"))
    return best.join(popular, "item_id", "left").withColumn("posting", F.round(F.col("score") * (1 + F.log1p(F.coalesce("positive", F.lit(0)).cast("double")) * 0.04), 4)).drop("positive")


def postings(index: DataFrame, per_term: int = 250) -> DataFrame:
    """(term, item_id, posting, rank) of a term index."""
    return top(index.select("term", "item_id", "posting"), ["term"], [F.desc("posting"), F.desc("item_id")], per_term)


def bm25_index(items: DataFrame) -> DataFrame:
    """(item_id, term, tf, dl, idf, avgdl): document = name, category, summary, metadata values."""
    listed = items.select("item_id", T.terms(item_text(keys=False)).alias("ts")).withColumn("dl", F.size("ts"))
    whole = listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = float(max(whole["n"] or 0, 1)), float(whole["avgdl"] or 1.0)
    counts = listed.select("item_id", "dl", F.explode("ts").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return counts.join(df, "term").select("item_id", "term", "tf", "dl", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.lit(avgdl).alias("avgdl"))


def bm25_score(tf: Column, dl: Column, idf: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def transitions(train: DataFrame, k: int = 120) -> DataFrame:
    """(kind, src, dst, score, rank): next liked item after an item, and after a category, by share of the maximum."""
    order = Window.partitionBy("user_id").orderBy("ts", "review_id")
    steps = train.where("rating >= 4").withColumn("nxt", F.lead("item_id").over(order)).where("nxt is not null")
    edges = steps.select(F.explode(F.array(F.struct(F.lit("item").alias("kind"), F.col("item_id").alias("src")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("src")))).alias("e"), F.col("nxt").alias("dst")).select("e.kind", "e.src", "dst").where("kind = 'category' or src <> dst")
    counts = edges.groupBy("kind", "src", "dst").agg(F.count("*").alias("n"))
    return normalised_top(counts, ["kind", "src"], "n", "dst", k)


def normalised_top(counts: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """First ``k`` per key by value, as a share of the key's maximum to four places."""
    peak = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    ranked = counts.withColumn("rank", F.row_number().over(peak)).where(F.col("rank") <= k)
    return ranked.withColumn("score", F.round(F.col(value) / F.first(value).over(peak), 4)).select(*keys, tie, "score", "rank")


def aspect_matches(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep..., aspect, hits): distinct keywords of each aspect in the text; aspects without a hit have no row."""
    found = F.array_distinct(T.without(T.terms(text), ASPECT_STOPWORDS))
    counts = T.once(found, lambda t: F.array(*(F.struct(F.lit(a).alias("aspect"), F.size(F.array_intersect(t, F.array(*map(F.lit, words)))).alias("hits")) for a, words in ASPECTS.items())))
    return rows.select(*keep, F.explode(counts).alias("e")).select(*keep, "e.aspect", "e.hits").where("hits > 0")


def scaled_aspects(raw: DataFrame, key: str, value: str) -> DataFrame:
    """(key, aspect, score): sums over the key's largest absolute sum, within [-1, 1], four places."""
    peak = F.max(F.abs(F.col(value))).over(Window.partitionBy(key))
    return raw.withColumn("peak", peak).where("peak > 0").select(key, "aspect", F.round(F.greatest(F.least(F.col(value) / F.col("peak"), F.lit(1.0)), F.lit(-1.0)), 4).alias("score"))


def item_aspects(items: DataFrame) -> DataFrame:
    """(item_id, aspect, score) of the catalogue text."""
    return scaled_aspects(aspect_matches(items, item_text(), "item_id"), "item_id", "hits")


def user_aspects(train: DataFrame) -> DataFrame:
    """(user_id, aspect, score): keyword hits weighted by recency (1 to 1.35) and sentiment (1, -0.85 or 0.35)."""
    order = Window.partitionBy("user_id").orderBy("ts", "review_id")
    place = F.row_number().over(order) - 1
    size = F.count("*").over(Window.partitionBy("user_id"))
    mood = F.when(F.col("rating") >= 4, 1.0).when(F.col("rating") <= 2, -0.85).otherwise(0.35)
    weighted = train.withColumn("w", (1 + place / size * 0.35) * mood)
    hits = aspect_matches(weighted, T.join_parts(F.col("name"), F.col("category"), F.col("review")), "user_id", "w")
    return scaled_aspects(hits.groupBy("user_id", "aspect").agg(F.sum(F.col("w") * F.col("hits")).alias("raw")), "user_id", "raw")


def popularity_score(n: Column, ceiling: int = 1000) -> Column:
    return F.when(n > 0, F.least(F.log1p(n.cast("double")) / F.log1p(F.lit(float(ceiling))), F.lit(1.0))).otherwise(0.0)


def aspect_evidence(train: DataFrame, items: DataFrame) -> DataFrame:
    """(category, aspect, item_id, w): catalogue evidence with quality and popularity, plus positive reviews, written once."""
    base = 0.6 * F.coalesce(F.nullif("average_rating", F.lit(0.0)), F.lit(3.5)) / 5 + 0.4 * popularity_score(F.col("popularity"))
    about = item_aspects(items).join(items.select("item_id", "category", base.alias("base")), "item_id").select("category", "aspect", "item_id", (F.greatest("score", F.lit(0.05)) + F.col("base")).alias("w"))
    one = scaled_aspects(aspect_matches(train.where("rating >= 4"), T.join_parts(F.col("name"), F.col("category"), F.col("review")), "review_id", "item_id").groupBy("review_id", "item_id", "aspect").agg(F.sum("hits").alias("hits")).withColumn("k", F.struct("review_id", "item_id")), "k", "hits")
    said = one.select(F.col("k.item_id").alias("item_id"), "aspect", F.col("score").alias("w")).join(items.select("item_id", "category"), "item_id").select("category", "aspect", "item_id", "w")
    sums = about.unionByName(said).groupBy("category", "aspect", "item_id").agg(F.round(F.sum("w"), 6).alias("w"))
    return train.sparkSession.read.parquet(write_table(sums, "evidence", compression="zstd"))


def aspect_items(evidence: DataFrame, by_category: bool = False, k: int = 120) -> DataFrame:
    """(category?, aspect, item_id, score, rank) of ``aspect_evidence``, best first; an item has one category."""
    return normalised_top(evidence, ["category", "aspect"] if by_category else ["aspect"], "w", "item_id", k)


def cosine_neighbors(train: DataFrame, items: DataFrame, k: int = 120, min_positive: int = 1, per_user: int = 500) -> DataFrame:
    """(item_id, neighbor_id, score, rank): cosine of item columns of the user-item matrix (ratings summed, floor 0.1).

    Only items with ``min_positive`` positive ratings are sources. Items are numbered in the order of their ids, so products
    and ties are handled on numbers. Pairs that only the users with more than ``per_user`` items share are searched, not listed.
    """
    known = items.select("item_id").distinct()
    number = cut(stats.ranked_globally(known, [F.col("item_id")], "i").select("item_id", "i"))
    cells = train.join(number, "item_id").groupBy("user_id", "i").agg(F.sum(F.greatest("rating", F.lit(0.1))).alias("v"))
    cells = cut(cells)
    both = gram.nearest_columns(cells, "user_id", k, per_user)
    sources = train.where("rating >= 4").groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_positive).join(number, "item_id").select(F.col("i").alias("src"))
    best = top(both, ["src"], [F.desc("score"), "dst"], k).join(sources, "src", "left_semi")
    names = number.select(F.col("i").alias("dst"), F.col("item_id").alias("neighbor_id"))
    return best.join(number.select(F.col("i").alias("src"), "item_id"), "src").join(names, "dst").select("item_id", "neighbor_id", "score", "rank")
