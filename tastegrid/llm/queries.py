"""The pN_ queries of the llm operators over the test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm import cooccurrence, cross_split, distinctive, leakage, lookalike, mixture, near_dups, topn, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _liked(low: float, high: float):
    return (F.col("rating") >= low) & (F.col("rating") <= high)


def p1_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item pairs shared by at least 4 users' baskets, 5 times more often than chance, with counts and lift."""
    liked = _table(spark, sf_dir, "reviews").where(_liked(4, 5))
    return cooccurrence.cooccurrence(liked, F.col("user_id"), F.col("item_id"), min_count=4, min_lift=5)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_cooccurrence(spark, sf_dir).select(F.col("item_a").alias("item_id_a"), F.col("item_b").alias("item_id_b"))


def p2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every item with score and fresh rank."""
    return topn.top_n(_table(spark, sf_dir, "item_neighbors"), "item_id", "neighbor_id", "score", 10)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_top10(spark, sf_dir).select("item_id", "neighbor_id")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _table(spark, sf_dir, "reviews")
    return cross_split.overlaps(reviews, "review_id", "review", F.col("split_name").isin("test_task_a", "test_task_b"), F.col("split_name") == "train", context=("user_id", "item_id"), shingle=3, similarity=0.5, min_words=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select(F.least("eval_id", "train_id").alias("review_id_a"), F.greatest("eval_id", "train_id").alias("review_id_b")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test split and feed: test records that overlap the training split, and overlapping pairs."""
    reviews = _table(spark, sf_dir, "reviews").select(F.col("review_id").alias("eval_id"), "split_name", "feed").where("eval_id is not null and split_name <> 'train'").distinct()
    pairs = _overlaps(spark, sf_dir)
    return reviews.join(pairs, "eval_id").groupBy("split_name", "feed").agg(F.countDistinct("eval_id").alias("n_records"), F.countDistinct("eval_id", "train_id").alias("n_pairs"), F.sum((F.col("word_edits") == 0).cast("int")).alias("n_exact"))


def _weights(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    liked = _table(spark, sf_dir, "reviews").where(_liked(4, 5))
    return distinctive.term_weights(liked, "review_id", "item_id", "review", **kwargs)


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 most characteristic terms of every item by divergence from randomness."""
    best = distinctive.best_terms(_weights(spark, sf_dir), "dfr_weight", 18)
    return best.select(F.col("item").alias("item_id"), "term", F.round("dfr_weight", 4).alias("score"), "rank")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = distinctive.best_terms(_weights(spark, sf_dir, min_reviews=3, max_share=(1, 20)), "idf_weight", 3)
    return best.select(F.col("item").alias("item_id"), "term")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other users of every user, with the cosine."""
    return vectors.most_similar(_table(spark, sf_dir, "user_profiles"), "user_id", "embedding", 5, order_col="updated_at").withColumn("similarity", F.round("similarity", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.most_similar(_table(spark, sf_dir, "user_profiles"), "user_id", "embedding", 5, min_similarity=0.9, order_col="updated_at")
    return near.select(F.least("id", "neighbor_id").alias("user_id_a"), F.greatest("id", "neighbor_id").alias("user_id_b")).distinct()


def _near(spark: SparkSession, sf_dir: str) -> near_dups.NearDuplicates:
    train = _table(spark, sf_dir, "reviews").where("split_name = 'train'")
    return near_dups.find(train, "review_id", "review", shingle=3, similarity=0.5, min_words=20)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.record_pairs(_near(spark, sf_dir)).select(F.col("rid_a").alias("review_id_a"), F.col("rid_b").alias("review_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every train record: texts of 20 words or more by links as in p6_found, shorter ones by equal words; alone without a partner."""
    train = _table(spark, sf_dir, "reviews").where("split_name = 'train'")
    found = near_dups.find(train, "review_id", "review", shingle=3, similarity=0.5, whole_below=20, all_pairs=False)
    return near_dups.groups(found, train.select("review_id")).select(F.col("rid").alias("review_id"), "group_id")


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train records of 20 words or more with a near-duplicate or copy, with the number of different texts linked to theirs."""
    return near_dups.link_counts(_near(spark, sf_dir)).select(F.col("rid").alias("review_id"), "n_links")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_passages"), "passage_id", "text", span=13)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their tokens, rate and copies."""
    drawn, _ = mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_targets"))
    return drawn.select(F.col("id").alias("doc_id"), "source", "tokens", "rate", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of tokens per source."""
    _, report = mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_targets"))
    return report


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that read like others stored differently: their class by its least id, and the stored forms of the class."""
    return lookalike.lookalike_groups(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    return lookalike.canonical(_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_cooccurrence, p2_found, p2_top10, p3_found, p3_report, p4_found, p4_terms, p5_found, p5_neighbours, p6_found, p6_groups, p6_links, p8_found, p9_mixture, p9_shares, p10_found, p10_classes, p10_canonical)}
