"""Queries of the engine's own operators over the review tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tastegrid.functions import text as T
from tastegrid.operators import evaluation, indexes, interactions as I, mixing, profiles, ranking, rating, retrieval, stats
from tastegrid.plans.scratch import cut, scratch_path, write_table
from tastegrid.streaming import live


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.interactions(table(spark, sf_dir, "reviews"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.train_of(inter(spark, sf_dir))


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.test_of(inter(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.items(table(spark, sf_dir, "items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def covis_recommend_top10(spark, sf_dir):
    """Flagship (R01, J05, J09, A17): ten best co-visitation candidates of every user with a test row."""
    t = train(spark, sf_dir)
    users = test(spark, sf_dir).select("user_id")
    history = t.join(users, "user_id", "left_semi")
    found = retrieval.co_visitation(history, indexes.covisitation(t), limit=35)
    return indexes.top(found.drop("rank"), ["user_id"], [F.desc("score"), "item_id"], 10)


@query
def s05_interactions(spark, sf_dir):
    """Valid reviews once, with coalesced columns and one time unit."""
    return inter(spark, sf_dir).select("review_id", "user_id", "item_id", "name", "rating", "category", "ts")


@query
def s04_items(spark, sf_dir):
    """The catalogue once per item with popularity from its metadata."""
    return items(spark, sf_dir).select("item_id", "name", "category", "summary", "average_rating", "popularity")


@query
def j02_reviewed_items(spark, sf_dir):
    """Catalogue items that have reviews."""
    return items(spark, sf_dir).join(inter(spark, sf_dir), "item_id", "left_semi").select("item_id", "category")


@query
def j01_reviews_with_metadata(spark, sf_dir):
    """Name and category of reviews from the catalogue, else their own."""
    own = inter(spark, sf_dir)
    meta = items(spark, sf_dir).select("item_id", F.col("name").alias("m_name"), F.col("category").alias("m_category"))
    return own.join(meta, "item_id", "left").select("review_id", "item_id", F.coalesce("m_name", "name").alias("name"), F.coalesce("m_category", "category").alias("category"))


@query
def w01_temporal_split(spark, sf_dir):
    """Last interaction of each user with two or more is the test row."""
    return I.temporal_split(inter(spark, sf_dir)).select("review_id", "is_test")


@query
def j04_histories(spark, sf_dir):
    """Training history of every test user, oldest first."""
    users = test(spark, sf_dir).select("user_id")
    rows = train(spark, sf_dir).join(users, "user_id", "left_semi")
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "review_id", "item_id"))), lambda x: x["item_id"]), ",").alias("items"))


@query
def proj07_stride_sample(spark, sf_dir):
    """200 evenly spread test rows."""
    return I.stride_sample(test(spark, sf_dir), ["review_id"], 200).select("review_id", "ordinal")


@query
def proj08_shards(spark, sf_dir):
    """Shard 1 of 3 of the test rows."""
    return I.shard(test(spark, sf_dir), ["review_id"], 3, 1).select("review_id")


@query
def proj09_history_buckets(spark, sf_dir):
    """Both bucketings of test users by training history."""
    sizes = train(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    rows = test(spark, sf_dir).join(sizes, "user_id").select(I.history_bucket(F.col("n")).alias("ranking_bucket"), I.rating_bucket(F.col("n")).alias("rating_bucket"))
    return rows.groupBy("ranking_bucket", "rating_bucket").agg(F.count("*").alias("n_users"))


@query
def proj16_items_with_popularity(spark, sf_dir):
    """Catalogue popularity replaced by training likes where there are some."""
    likes = train(spark, sf_dir).where("rating >= 4").groupBy("item_id").agg(F.count("*").alias("likes"))
    return items(spark, sf_dir).join(likes, "item_id", "left").select("item_id", F.coalesce("likes", "popularity").alias("popularity"))


@query
def a02_item_rollup(spark, sf_dir):
    """Reviews, mean, first name and category per item."""
    return stats.item_rollup(inter(spark, sf_dir))


def _stats(*keys: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        s = stats.rating_stats(train(spark, sf_dir), *keys)
        return s.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6)).withColumn("positive_share", F.round("positive_share", 6)).withColumn("negative_share", F.round("negative_share", 6))

    return run


QUERIES["a03_global_stats"] = _stats()
QUERIES["a03_user_stats"] = _stats("user_id")
QUERIES["a03_item_stats"] = _stats("item_id")
QUERIES["a03_category_stats"] = _stats("category")
QUERIES["a03_user_category_stats"] = _stats("user_id", "category")


@query
def a06_recent_means(spark, sf_dir):
    """Mean of each user's three latest ratings."""
    return stats.recent_means(train(spark, sf_dir)).withColumn("recent_mean", F.round("recent_mean", 6))


@query
def a08_popularity(spark, sf_dir):
    """Catalogue items by likes."""
    return stats.popularity(train(spark, sf_dir), items(spark, sf_dir), True)


@query
def a09_popularity_all(spark, sf_dir):
    """Catalogue items by all ratings."""
    return stats.popularity(train(spark, sf_dir), items(spark, sf_dir), False)


@query
def a10_latest_pairs(spark, sf_dir):
    """A10: latest liked interaction of each user and item."""
    return indexes.latest_positive(train(spark, sf_dir)).select("user_id", "item_id", "rating", "ts")


@query
def a11_user_items(spark, sf_dir):
    """Each user's 50 best-rated latest items."""
    return indexes.user_positive_items(train(spark, sf_dir)).select("user_id", "item_id", "rating", "ts", "rank")


@query
def a11_item_users(spark, sf_dir):
    """Each item's 500 best-rating users."""
    return indexes.item_positive_users(train(spark, sf_dir)).select("item_id", "user_id", "rating", "rank")


@query
def j05_covisitation(spark, sf_dir):
    """20 co-visitation neighbours per item."""
    return indexes.covisitation(train(spark, sf_dir))


@query
def a12_item_terms(spark, sf_dir):
    """18 best review terms per item with posting score."""
    return indexes.review_term_index(train(spark, sf_dir), items(spark, sf_dir))


@query
def a12_term_items(spark, sf_dir):
    """Postings, 250 items per term."""
    return indexes.postings(indexes.review_term_index(train(spark, sf_dir), items(spark, sf_dir)))


@query
def a13_bm25_index(spark, sf_dir):
    """Term counts, lengths and idf of the catalogue."""
    return indexes.bm25_index(items(spark, sf_dir)).select("item_id", "term", "tf", "dl", F.round("idf", 6).alias("idf"))


@query
def a14_category_rank(spark, sf_dir):
    """Popularity order within each category."""
    order = [F.desc("popularity"), F.desc(F.coalesce("average_rating", F.lit(0.0))), F.desc("item_id")]
    return indexes.top(items(spark, sf_dir), ["category"], order, 200).select("category", "item_id", "rank")


@query
def a15_transitions(spark, sf_dir):
    """Item and category transition edges."""
    return indexes.transitions(train(spark, sf_dir))


@query
def a15_aspect_items(spark, sf_dir):
    """Aspect to item edges."""
    return indexes.aspect_items(indexes.aspect_evidence(train(spark, sf_dir), items(spark, sf_dir)))


@query
def a19_cosine_neighbors(spark, sf_dir):
    """Cosine neighbours of item columns."""
    return indexes.cosine_neighbors(_split(spark, sf_dir)[0], items(spark, sf_dir), k=20)


@query
def a20_user_numbers(spark, sf_dir):
    """Numeric profile of every user."""
    return profiles.user_numbers(train(spark, sf_dir))


@query
def a21_top_terms(spark, sf_dir):
    """Liked and disliked terms of every user."""
    return profiles.top_terms(train(spark, sf_dir))


@query
def a21_preferred_categories(spark, sf_dir):
    """Preferred categories of every user."""
    return retrieval.preferred_categories(train(spark, sf_dir))


@query
def a21_category_affinity(spark, sf_dir):
    """Category affinity of every user."""
    return profiles.category_affinity(train(spark, sf_dir))


@query
def a22_user_aspects(spark, sf_dir):
    """Signed aspect scores of every user."""
    return indexes.user_aspects(train(spark, sf_dir))


@query
def a22_item_aspects(spark, sf_dir):
    """Aspect scores of the catalogue."""
    return indexes.item_aspects(items(spark, sf_dir))


@query
def a23_dataset_summary(spark, sf_dir):
    """A26 and the counts of A23: exact distincts, histogram, time range, density of the valid interactions."""
    return stats.dataset_summary(inter(spark, sf_dir))


@query
def a25_history_distribution(spark, sf_dir):
    """Nearest-rank distribution of reviews per user."""
    return stats.distribution(inter(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_rows")), "n_rows")


@query
def a34_target_ratings(spark, sf_dir):
    """Liked and other test targets."""
    rows = test(spark, sf_dir).groupBy(F.when(F.col("rating") >= 4, "positive").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))
    return rows


def _split(spark, sf_dir):
    """Training rows, those of test users, and test rows, from one copy of the split on disk of which each use reads the columns it needs."""
    split = spark.read.parquet(write_table(I.with_split(inter(spark, sf_dir)), "split", compression="zstd"))
    rest = split.where("not is_test")
    return rest.drop("is_test", "has_test"), rest.where("has_test").drop("is_test", "has_test"), split.where("is_test").drop("is_test", "has_test")


def _history(spark, sf_dir):
    t, history, _ = _split(spark, sf_dir)
    return t, history


@query
def r01_co_visitation(spark, sf_dir):
    """Co-visitation candidates of test users."""
    t, history = _history(spark, sf_dir)
    return retrieval.co_visitation(history, indexes.covisitation(t))


@query
def r02_user_neighbor(spark, sf_dir):
    """Two-hop candidates of test users."""
    t, history = _history(spark, sf_dir)
    return retrieval.user_neighbors(history, indexes.item_positive_users(t), indexes.user_positive_items(t))


@query
def r03_implicit_item_item(spark, sf_dir):
    """Cosine-neighbour candidates of test users."""
    t, history = _history(spark, sf_dir)
    return retrieval.implicit_items(history, indexes.cosine_neighbors(t, items(spark, sf_dir)))


@query
def r04_review_terms(spark, sf_dir):
    """Review-term candidates of test users."""
    t, history = _history(spark, sf_dir)
    catalogue = items(spark, sf_dir)
    index = cut(indexes.review_term_index(t, catalogue))
    return retrieval.review_terms(history, index, indexes.postings(index), retrieval.preferred_categories(history), catalogue)


@query
def r06_lexical_neighbors(spark, sf_dir):
    """Lexical-neighbour candidates of test users."""
    t, history = _history(spark, sf_dir)
    index = cut(indexes.review_term_index(t, items(spark, sf_dir)))
    return retrieval.lexical_neighbors(history, index, indexes.postings(index))


@query
def r08_evidence_graph(spark, sf_dir):
    """Graph candidates of test users with their strongest path."""
    t, history = _history(spark, sf_dir)
    catalogue = items(spark, sf_dir)
    evidence = indexes.aspect_evidence(t, catalogue)
    return retrieval.evidence_graph(history, indexes.transitions(t), indexes.aspect_items(evidence), indexes.aspect_items(evidence, by_category=True), indexes.user_aspects(history), retrieval.preferred_categories(history))


@query
def r13_bm25(spark, sf_dir):
    """BM25 candidates of test users for their liked terms."""
    t, history = _history(spark, sf_dir)
    return retrieval.bm25(_liked_words(history), indexes.bm25_index(items(spark, sf_dir)))


@query
def r24_category_popular(spark, sf_dir):
    """Popular items of preferred categories."""
    _, history = _history(spark, sf_dir)
    return retrieval.category_popular(history, items(spark, sf_dir))


@query
def r26_global_popular(spark, sf_dir):
    """Most popular unseen items of test users."""
    _, history = _history(spark, sf_dir)
    return retrieval.global_popular(history, items(spark, sf_dir))


def _liked_words(history: DataFrame) -> DataFrame:
    return profiles.top_terms(history).where("mood = 'liked'").select("user_id", "term", F.lit(1).alias("times"))


def _kept(found: DataFrame) -> DataFrame:
    """Candidates written once: fill, merge and masks each read them."""
    return found.sparkSession.read.parquet(write_table(found, "source", compression="zstd"))


def _sources(spark, sf_dir):
    """History, catalogue and every built source by its name; the graph's candidates stand under their strongest kind of edge."""
    return _pool_tables(spark, sf_dir)[:3]


def _pool_tables(spark, sf_dir):
    """``_sources``, then the test rows, the training rows and the co-visitation neighbours, all from the one stored split."""
    t, history, targets = _split(spark, sf_dir)
    catalogue = cut(items(spark, sf_dir))
    liked = cut(_liked_words(history))
    terms = cut(indexes.review_term_index(t, catalogue))
    posted = cut(indexes.postings(terms))
    preferred = cut(retrieval.preferred_categories(history))
    evidence = indexes.aspect_evidence(t, catalogue)
    graph = retrieval.evidence_graph(history, indexes.transitions(t), indexes.aspect_items(evidence), indexes.aspect_items(evidence, by_category=True), indexes.user_aspects(history), preferred)
    neighbors = _kept(indexes.covisitation(t))
    found = {
        "co_visitation": retrieval.co_visitation(history, neighbors),
        "user_neighbor": retrieval.user_neighbors(history, indexes.item_positive_users(t), indexes.user_positive_items(t)),
        "implicit_item_item": retrieval.implicit_items(history, indexes.cosine_neighbors(t, catalogue)),
        "review_term_profile": retrieval.review_terms(history, terms, posted, preferred, catalogue),
        "lexical_item_neighbor": retrieval.lexical_neighbors(history, terms, posted),
        **retrieval.graph_sources(graph, history),
        "bm25_profile": retrieval.bm25(liked, indexes.bm25_index(catalogue), history=history),
        "aspect_profile": retrieval.aspect_profile(history, liked, catalogue),
        "sparse_category_tail": retrieval.sparse_tail(history, catalogue),
        "category_affinity_popular": retrieval.category_popular(history, catalogue),
        "global_popular": retrieval.global_popular(history, catalogue),
    }
    return history, catalogue, {n: f if n in retrieval.GRAPH_SOURCES else _kept(f) for n, f in found.items()}, targets, t, neighbors


@query
def r18_aspect_profile(spark, sf_dir):
    """Items of preferred categories that hold a user's liked terms."""
    _, history = _history(spark, sf_dir)
    return retrieval.aspect_profile(history, _liked_words(history), items(spark, sf_dir))


@query
def r22_sparse_tail(spark, sf_dir):
    """Evenly spaced items of preferred categories for users with little history."""
    _, history = _history(spark, sf_dir)
    return retrieval.sparse_tail(history, items(spark, sf_dir))


def _mixed(sources, history, catalogue):
    """Pool of the sources with the category fill (R25) after the mixer's stages."""
    return retrieval.mix(retrieval.merge(retrieval.with_fill(sources, history, catalogue)), catalogue, history)


def _ranks(sources, history, catalogue):
    """(user_id, item_id, rank) of the pool."""
    return mixing.mixed(sources, {"all": (list(sources), True)}, history, catalogue).drop("mask")


@query
def u02_candidate_pool(spark, sf_dir):
    """U02, F16, R25, the mixer with floors, protected and exploring candidates (T11, U03-U05): 100 candidates per user from all built sources."""
    history, catalogue, sources = _sources(spark, sf_dir)
    return _mixed(sources, history, catalogue).select("user_id", "item_id", "n_sources", "priority", "stage", "rank")


@query
def a28_ranking_metrics(spark, sf_dir):
    """Hit rate and NDCG of the pool per slice."""
    history, catalogue, sources, targets, _, _ = _pool_tables(spark, sf_dir)
    ranked = evaluation.target_ranks(targets.select("user_id", "item_id", "category"), _ranks(sources, history, catalogue))
    return evaluation.ranking_metrics(evaluation.with_slices(ranked, history), (10, 50, 100), "slice")


def _vectors(tokens: DataFrame, key: str) -> DataFrame:
    """(key, vector): the hashed slots as one array of 64 numbers."""
    slots = profiles.hashed_vectors(tokens, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    return slots.select(key, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


def _aspect_map(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("aspect", "score"))).alias("aspects"))


@query
def g06_ranked_top10(spark, sf_dir):
    """The ten best pool candidates of every test user by the hybrid score."""
    history, catalogue, sources = _sources(spark, sf_dir)
    pool = _mixed(sources, history, catalogue)
    affinity = profiles.category_affinity(history).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "affinity"))).alias("category_affinity"))
    said = history.where("rating >= 4").select("user_id", F.explode(T.terms(T.join_parts(F.col("name"), F.col("category"), F.col("review")))).alias("term"))
    users = profiles.user_profiles(history).select("user_id", "confidence", "preferred_terms", "disliked_terms", "preferred_categories").join(affinity, "user_id", "left").join(_aspect_map(indexes.user_aspects(history), "user_id"), "user_id", "left").join(_vectors(said, "user_id"), "user_id", "left")
    about = catalogue.select("item_id", F.explode(T.terms(indexes.item_text(False))).alias("term"))
    things = profiles.item_profiles(catalogue).join(_aspect_map(indexes.item_aspects(catalogue), "item_id"), "item_id", "left").join(_vectors(about, "item_id"), "item_id", "left")
    return ranking.rank(ranking.features(pool, users, things), 10).select("user_id", "item_id", F.round("raw_score", 4).alias("raw_score"), "score", "rank")


@query
def a33_miss_causes(spark, sf_dir):
    """Causes why test targets are missing from the pool, counted per cause and history bucket."""
    history, catalogue, sources, targets, t, neighbors = _pool_tables(spark, sf_dir)
    ranked = evaluation.target_ranks(targets.select("user_id", "item_id", "category"), _ranks(sources, history, catalogue))
    return evaluation.miss_causes(ranked, history, t, neighbors).groupBy("cause", "bucket").agg(F.count("*").alias("n"))


@query
def a32_source_diagnostics(spark, sf_dir):
    """A31 and the sources of A32, without families and misses: candidates, hits and recall per source; null for sources that did not run."""
    history, catalogue, sources, targets, _, _ = _pool_tables(spark, sf_dir)
    sources = retrieval.with_fill(sources, history, catalogue)
    long = evaluation.union_by_name([f.withColumn("source", F.lit(n)) for n, f in sources.items()])
    return evaluation.source_diagnostics(long, targets, sources)


@query
def m03_rating_features(spark, sf_dir):
    """Shrunken priors of every test row."""
    f = rating.features(test(spark, sf_dir), train(spark, sf_dir))
    return f.select("review_id", "rating", "user_n", "item_n", *(F.round(c, 6).alias(c) for c in ("user_prior", "user_recent_prior", "item_prior", "category_prior", "user_category_prior", "bias_prior")))


@query
def a27_rating_errors(spark, sf_dir):
    """MAE and RMSE of the built prediction heads, without M05."""
    return evaluation.rating_errors(rating.predictions(rating.features(test(spark, sf_dir), train(spark, sf_dir))), rating.HEADS)


@query
def a30_rating_slices(spark, sf_dir):
    """The same per history bucket and per category, slices of one row left out."""
    p = rating.predictions(rating.features(test(spark, sf_dir), train(spark, sf_dir)))
    named = F.explode(F.array(F.concat(F.lit("history:"), I.rating_bucket(F.col("user_n"))), F.concat(F.lit("category:"), F.col("category"))))
    return evaluation.rating_errors(p.withColumn("slice", named), rating.HEADS, "slice").where("n >= 2")


@query
def m08_linear_rating(spark, sf_dir):
    """Errors of a linear model on the priors, trained on one half of the test rows, scored on the other."""
    f = rating.features(test(spark, sf_dir), train(spark, sf_dir)).withColumn("half", F.pmod(F.xxhash64("review_id"), F.lit(2)))
    model = rating.fit_linear(f.where("half = 0"), ["user_prior", "item_prior", "category_prior", "user_category_prior", "user_recent_prior"])
    return evaluation.rating_errors(rating.predict_linear(f.where("half = 1"), model, "head_linear"), ["head_linear", "bias_prior"])


@query
def m09_star_thresholds(spark, sf_dir):
    """Thresholds that cut the calibrated prediction into stars, and the error they give."""
    p = rating.predictions(rating.features(test(spark, sf_dir), train(spark, sf_dir)))
    cuts = rating.star_thresholds(p, "head_calibrated")
    return evaluation.rating_errors(p.withColumn("head_stars", rating.stars(F.col("head_calibrated"), cuts)), ["head_stars", "head_calibrated"])


@query
def m10_blend(spark, sf_dir):
    """Blend of the heads with the least RMSE on the simplex grid."""
    p = rating.predictions(rating.features(test(spark, sf_dir), train(spark, sf_dir)))
    w = rating.fit_blend(p, ["head_user", "head_item", "head_calibrated", "head_bias_prior", "head_adaptive"])
    return evaluation.rating_errors(p.withColumn("head_blend", sum((F.col(h) * v for h, v in w.items()), F.lit(0.0))), ["head_blend", *rating.HEADS])


@query
def f09_hashed_vectors(spark, sf_dir):
    """Hashed unit vectors of the catalogue text, long form."""
    tokens = items(spark, sf_dir).select("item_id", F.explode(T.terms(indexes.item_text(False))).alias("term"))
    return profiles.hashed_vectors(tokens, "item_id")


@query
def f20_item_profiles(spark, sf_dir):
    """item profiles."""
    return profiles.item_profiles(items(spark, sf_dir)).withColumn("terms", F.array_join("terms", " "))


@query
def f21_text_metrics(spark, sf_dir):
    """unigram and longest-common-subsequence F1 of each item's summary against its name."""
    pairs = items(spark, sf_dir).select("item_id", F.regexp_extract_all(F.lower("summary"), F.lit("[a-zA-Z0-9]+"), F.lit(0)).alias("a"), F.regexp_extract_all(F.lower("name"), F.lit("[a-zA-Z0-9]+"), F.lit(0)).alias("b"))
    return pairs.select("item_id", F.round(evaluation.unigram_f1(F.col("a"), F.col("b")), 6).alias("unigram_f1"), F.round(evaluation.rouge_l_f1(F.col("a"), F.col("b")), 6).alias("rouge_l_f1"))


@query
def j18_prior_features(spark, sf_dir):
    """Mean and number of the earlier ratings of the same user, for every training row."""
    prior = Window.partitionBy("user_id").orderBy("ts", "review_id").rowsBetween(Window.unboundedPreceding, -1)
    return train(spark, sf_dir).select("review_id", F.count("rating").over(prior).alias("n_prior"), F.round(F.avg("rating").over(prior), 6).alias("mean_prior"))


@query
def proj11_cross_domain(spark, sf_dir):
    """Test targets whose category the user never liked."""
    liked = train(spark, sf_dir).where("rating >= 4").select("user_id", "category").distinct()
    some = liked.select("user_id").distinct()
    targets = test(spark, sf_dir).select("review_id", "user_id", "category")
    return targets.join(some, "user_id", "left_semi").join(liked, ["user_id", "category"], "left_anti").select("review_id", "user_id", "category")


@query
def a35_merged_shards(spark, sf_dir):
    """Errors of the calibrated head per shard of the users, merged by example counts."""
    p = rating.predictions(rating.features(test(spark, sf_dir), train(spark, sf_dir)))
    shards = evaluation.rating_errors(p.withColumn("shard", F.pmod(F.conv(F.substring(F.sha2("user_id", 256), 1, 2), 16, 10).cast("int"), F.lit(4))), ["head_calibrated"], "shard")
    return evaluation.merge_shards(shards, ["mae"], "head")


@query
def a38_rating_summary(spark, sf_dir):
    """Count, mean, interpolated median, range and histogram of the ratings per category."""
    r = F.col("rating")
    return inter(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean"), F.percentile(r, 0.5).alias("median"), F.min(r).alias("low"), F.max(r).alias("high"), *(F.sum((F.floor(r) == k).cast("long")).alias(f"n_{k}") for k in range(1, 6)))


@query
def a37_event_metrics(spark, sf_dir):
    """Requests, users, mean and largest value per kind of event."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("requests"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


@query
def z01_last_feedback(spark, sf_dir):
    """The last event of each user and subject wins."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("user_id", "k").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


@query
def z04_stream_metrics(spark, sf_dir):
    """The same counts kept by a stream over the events file, after all of it has arrived."""
    import uuid

    source = table(spark, sf_dir, "events")
    name = f"metrics_{uuid.uuid4().hex}"
    counts = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events*.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@query
def z03_rate_limit(spark, sf_dir):
    """Events of each user allowed by a sliding log of at most five within a day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return live.rate_limit(e, 5, 86_400).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("allowed").cast("long")).alias("n_allowed"))


# Sources that every run of the ablation leaves out, and those that each mask leaves out besides.
ABLATION_BASE = ("vector_profile", "bm25_profile", "beauty_sparse_tail", "sparse_category_tail")
ABLATIONS = {
    "lean": (),
    "no_implicit_item_item": ("implicit_item_item",),
    "no_co_visitation": ("co_visitation",),
    "no_user_neighbor": ("user_neighbor",),
    "no_collaborative": ("co_visitation", "implicit_item_item", "user_neighbor", "sequential_transition", "category_transition"),
    "no_review_terms": ("review_term_profile", "beauty_review_term_profile", "lexical_item_neighbor", "beauty_lexical_item_neighbor"),
    "no_evidence_graph": ("aspect_evidence_graph", "category_aspect_graph", "sequential_transition", "category_transition"),
    "no_aspect_taxonomy": ("aspect_profile", "beauty_aspect_profile", "beauty_taxonomy_aspect", "beauty_taxonomy_window"),
    "no_popularity_fallback": ("category_affinity_popular", "category_popular", "global_popular"),
}


@query
def e05_source_ablation(spark, sf_dir):
    """Hit rates of the pool under each mask of sources; ``not_run`` names those of the mask that are not built and so change nothing."""
    history, catalogue, sources, targets, _, _ = _pool_tables(spark, sf_dir)
    lean = {n: f for n, f in sources.items() if n not in ABLATION_BASE}
    targets = targets.select("user_id", "item_id")
    masks = {m: ([n for n in lean if n not in names], "category_popular" not in names) for m, names in ABLATIONS.items()}
    absent = {m: ",".join(n for n in names if n not in sources and n != "category_popular") for m, names in ABLATIONS.items()}
    every = targets.crossJoin(F.broadcast(spark.createDataFrame(list(absent.items()), "left_out string, not_run string")))
    found = mixing.mixed(lean, masks, history, catalogue).withColumnRenamed("mask", "left_out")
    ranked = every.join(found, ["left_out", "user_id", "item_id"], "left")
    return evaluation.ranking_metrics(ranked, (10, 100), "left_out", "not_run").select("left_out", "n", "hit_10", "hit_100", "ndcg_10", "ndcg_100", "not_run")
