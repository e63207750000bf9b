"""Engine operators on small hand-made tables, with the awkward inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import text as T
from tastegrid.operators import evaluation, heavy_keys, indexes, interactions as I, profiles, rating, retrieval, stats

REVIEWS = "review_id string, user_id string, item_id string, item_name string, rating double, review string, category string, timestamp long, extra string"
ROWS = "review_id string, user_id string, item_id string, name string, rating double, review string, category string, ts long"
ITEMS = "item_id string, name string, category string, metadata map<string,string>, summary string, average_rating double"


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEWS)


def rows_of(spark, triples, text="nice text"):
    return spark.createDataFrame([(f"r{n}", u, i, i, float(r), text, c, t) for n, (u, i, r, c, t) in enumerate(triples)], ROWS)


def test_interactions_keep_valid_rows_once(spark):
    base = ("r1", "u", "i", "Name", 4.0, "text", " Book-Shop ", 1_600_000_000_000, "x")
    rows = [base, base, ("r2", None, "i", "n", 4.0, "t", "c", 1, "x"), ("r3", "u", "", "n", 4.0, "t", "c", 1, "x"), ("r4", "u", "i", "n", 0.0, "t", "c", 1, "x"), ("r5", "u", "i", "n", None, "t", "c", 1, "x"), ("r6", "u", "i", "n", float("nan"), "t", "c", 1, "x"), ("r7", "u", "i", None, 5.0, "x" * 100_000, None, None, "x"), ("r8", "u", "i", "n", 5.0, "  ", "c", 1, "x")]
    got = {r["review_id"]: r for r in I.interactions(reviews(spark, rows)).collect()}
    assert set(got) == {"r1", "r7"}
    assert got["r1"]["category"] == "book_shop" and got["r1"]["ts"] == 1_600_000_000
    assert got["r7"]["name"] == "i" and got["r7"]["category"] == "unknown" and got["r7"]["ts"] == 0
    assert I.interactions(reviews(spark, [])).count() == 0


def test_items_read_popularity_from_metadata(spark):
    rows = [("a", None, "X", {"rating_number": "0", "review_count": "7"}, None, float("nan")), ("b", "B", None, {"rating_number": "12", "review_count": "7"}, "s", 4.0), ("c", "C", "c", {}, "s", None), ("d", "D", "c", None, "s", 1.0), ("e", "E", "c", {"review_count": "many"}, "s", 1.0), (None, "N", "c", None, "s", 1.0)]
    got = {r["item_id"]: r for r in I.items(spark.createDataFrame(rows, ITEMS)).collect()}
    assert {k: v["popularity"] for k, v in got.items()} == {"a": 7, "b": 12, "c": 0, "d": 0, "e": 0}
    assert got["a"]["average_rating"] is None and got["a"]["name"] == "a" and got["b"]["category"] == "unknown"


def test_temporal_split_takes_the_last_row(spark):
    rows = rows_of(spark, [("u", "a", 5, "c", 10), ("u", "b", 5, "c", 20), ("v", "a", 5, "c", 10)])
    assert [r["item_id"] for r in I.test_of(rows).collect()] == ["b"]
    assert I.train_of(rows).count() == 2
    assert I.train_of(rows.limit(0)).count() == 0


def test_shards_and_stride(spark):
    rows = spark.createDataFrame([(f"{i:02}",) for i in range(10)], "k string")
    assert sorted(r[0] for r in I.shard(rows, ["k"], 3, 0).collect()) == ["00", "03", "06", "09"]
    assert sorted(r["ordinal"] for r in I.stride_sample(rows, ["k"], 4).collect()) == [0, 2, 5, 7]
    assert I.stride_sample(rows, ["k"], 50).count() == 10
    assert I.stride_sample(rows.limit(0), ["k"], 5).count() == 0
    with pytest.raises(ValueError):
        I.shard(rows, ["k"], 2, 2)


def test_covisitation_edges(spark):
    rows = rows_of(spark, [("u", "a", 5, "c", 1), ("u", "b", 5, "c", 2), ("v", "a", 5, "c", 1), ("v", "b", 5, "c", 2), ("v", "z", 2, "c", 3)])
    got = {(r[0], r[1]): r[2] for r in indexes.covisitation(rows).collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 1.0}
    weighted = {(r[0], r[1]) for r in indexes.covisitation(rows, threshold=0.0, weighted=True).collect()}
    assert ("a", "z") in weighted
    assert indexes.covisitation(rows.limit(0)).count() == 0


def test_cosine_blocks_change_nothing(spark):
    rows = rows_of(spark, [(f"u{k % 3}", f"i{k * 7 % 23}", 1 + k % 5, "c", k) for k in range(120)])
    items = spark.createDataFrame([(f"i{k}",) for k in range(23)], "item_id string")
    whole = {tuple(r) for r in indexes.cosine_neighbors(rows, items).collect()}
    assert whole == {tuple(r) for r in indexes.cosine_neighbors(rows, items, per_user=4).collect()} and whole


def test_implicit_votes_normalise_to_one(spark):
    history = rows_of(spark, [("u", "seed", 5, "c", 1), ("u", "seen", 5, "c", 2)])
    edges = spark.createDataFrame([("seed", "n", 0.91, 1), ("seed", "seen", 0.99, 2)], "item_id string, neighbor_id string, score double, rank int")
    assert [tuple(r) for r in retrieval.implicit_items(history, edges).collect()] == [("u", "n", 1.0, 1)]


def test_transitions_skip_equal_items_only_between_items(spark):
    rows = rows_of(spark, [("u", "a", 5, "c", 1), ("u", "a", 5, "c", 2), ("u", "b", 4, "d", 3), ("u", "x", 1, "c", 4)])
    got = {(r["kind"], r["src"], r["dst"]): r["score"] for r in indexes.transitions(rows).collect()}
    assert got == {("item", "a", "b"): 1.0, ("category", "c", "a"): 1.0, ("category", "c", "b"): 1.0}


def test_review_terms_join_units_and_pair_neighbours(spark):
    df = spark.createDataFrame([("The cream 12 oz CREAM cream rich-soft this rich-soft", 1), (None, 2), ("", 3), ("for", 4)], "t string, k int")
    got = {r["k"]: r["x"] for r in df.select("k", T.review_terms(F.col("t")).alias("x")).collect()}
    assert got[1] == ["the", "cream", "cream", "cream", "rich-soft", "rich-soft", "the_cream", "cream_rich-soft"]
    assert got[2] == got[3] == got[4] == []


def test_hashed_vectors_follow_their_definition(spark):
    import hashlib

    words = ["alpha", "beta", "alpha", "gamma"]
    want = [0.0] * 64
    for w in set(words):
        d = hashlib.sha256(w.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 64] += (1 if d[4] % 2 == 0 else -1) * (1 + math.log(words.count(w)))
    norm = math.sqrt(sum(x * x for x in want))
    rows = spark.createDataFrame([("k", w) for w in words], "id string, term string")
    got = {r["slot"]: r["value"] for r in profiles.hashed_vectors(rows, "id").collect()}
    assert got == {i: round(x / norm, 6) for i, x in enumerate(want) if x}


def test_metrics(spark):
    ranked = spark.createDataFrame([("u", 1), ("v", 3), ("w", None), ("x", 11)], "user_id string, rank int")
    r = evaluation.ranking_metrics(ranked, (1, 10)).first()
    assert (r["n"], r["hit_1"], r["hit_10"]) == (4, 0.25, 0.5)
    assert r["ndcg_10"] == pytest.approx((1 + 1 / math.log2(4)) / 4, abs=1e-6)
    texts = spark.createDataFrame([("the cat sat on the mat".split(), "the cat lay on a mat".split()), ([], ["a"]), (["a"], ["b"]), (["a"], ["a"])], "a array<string>, b array<string>")
    got = texts.select(evaluation.unigram_f1(F.col("a"), F.col("b")), evaluation.rouge_l_f1(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(4 / 6) and got[0][1] == pytest.approx(4 / 6)
    assert tuple(got[1]) == (0, 0) and tuple(got[2]) == (0, 0) and tuple(got[3]) == (1, 1)


def test_shrinkage_and_features(spark):
    df = spark.createDataFrame([(5.0, 1, 3.0), (5.0, 0, 3.0), (5.0, None, 2.0)], "m double, n int, p double")
    assert [r[0] for r in df.select(rating.shrinkage(F.col("m"), F.col("n"), F.col("p"), 3.0)).collect()] == [3.5, 3.0, 2.0]
    train = rows_of(spark, [("u", "a", 5, "c", 1), ("u", "b", 3, "c", 2), ("v", "a", 1, "d", 1)])
    unknown = rows_of(spark, [("new", "new", 4, "new", 9)])
    f = rating.features(unknown, train).first()
    assert f["user_prior"] == f["item_prior"] == f["bias_prior"] == pytest.approx(3.0)
    assert rating.features(unknown, train.limit(0)).first()["user_prior"] == 3.5


@pytest.mark.parametrize("loss", ["mse", "mae", "huber"])
def test_linear_model_learns_the_direction(spark, loss):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), 1 + 0.5 * (i % 7)) for i in range(200)], "x double, y double, rating double")
    model = rating.fit_linear(rows, ["x", "y"], loss=loss, epochs=40)
    assert model["weights"][0] > 0.5 and abs(model["weights"][1]) < 0.1
    errors = evaluation.rating_errors(rating.predict_linear(rows, model, "p"), ["p"]).first()
    assert errors["rmse"] < 0.6


def test_heavy_keys(spark):
    rows = [("i1", f"u{k}", 4.0) for k in range(50)] + [("i2", "u1", None), (None, "u1", 2.0), ("i3", None, float("nan")), ("i4", "u1", 3.0), ("i4", "u1", 3.0)]
    df = spark.createDataFrame(rows, "item_id string, user_id string, rating double").withColumn("n", F.lit(0))
    got = {(r[0], r[1]): tuple(r)[2:] for r in heavy_keys.per_key(df, "item_id", "user_id", "rating").collect()}
    assert got["item_id", "i1"] == (50, 50, 4.0) and got["item_id", "i3"] == (1, 0, None) and got["item_id", "i2"] == (1, 1, None)
    assert got["user_id", "u1"] == (5, 3, 3.0) and ("item_id", None) not in got
    assert {tuple(r)[:2] for r in heavy_keys.heavy(df, ("item_id", "user_id"), 9).collect()} == {("item_id", "i1"), ("user_id", "u1")}
    assert heavy_keys.per_key(df.limit(0), "item_id", "user_id", "rating").count() == 0 and heavy_keys.heavy(df.limit(0), ("item_id",), 3).count() == 0


def test_user_numbers(spark):
    rows = rows_of(spark, [("u", "a", 1, "c", 1), ("u", "b", 2, "c", 2), ("u", "d", 4, "c", 3), ("u", "e", 5, "c", 4), ("v", "a", 5, "c", 1)], "one two three")
    got = {r["user_id"]: r for r in profiles.user_numbers(rows).collect()}
    u = got["u"]
    assert (u["average_rating"], u["recent_average_rating"], u["rating_trend"], u["rating_strictness"]) == (3.0, 3.67, 3.0, "strict")
    assert got["v"]["rating_std"] == 0.0 and got["v"]["rating_trend"] == 0.0 and got["v"]["review_length_mean"] == 3.0


def test_distribution_uses_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 38)], "v double")
    r = stats.distribution(df, "v").first()
    assert (r["n"], r["p50"], r["p90"], r["p99"], r["max"]) == (37, 19.0, 34.0, 37.0, 37.0)
    assert stats.distribution(df.limit(0), "v").first()["n"] == 0


def test_blend_puts_all_weight_on_the_perfect_head(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 3.0), (5.0, 5.0, 3.0), (2.0, 2.0, 3.0)], "rating double, good double, flat double")
    assert rating.fit_blend(rows, ["flat", "good"]) == {"good": 1.0}
    assert rating.fit_blend(rows.limit(0), ["flat", "good"]) == {"flat": 1.0}


def test_star_thresholds_separate_the_stars(spark):
    rows = spark.createDataFrame([(s + d / 100, float(s)) for s in range(1, 6) for d in range(10)], "p double, rating double")
    cuts = rating.star_thresholds(rows, "p")
    assert len(cuts) == 4 and cuts == sorted(cuts)
    got = rows.select("rating", rating.stars(F.col("p"), cuts).alias("s")).collect()
    assert all(r["rating"] == r["s"] for r in got)
    assert rating.star_thresholds(rows.limit(3), "p") == [1.5, 2.5, 3.5, 4.5]
    few = rating.star_thresholds(rows, "p", bins=10)
    assert few == pytest.approx(cuts, abs=0.1)


def test_global_popular_skips_seen_items(spark):
    items = spark.createDataFrame([(f"i{k}", 100 - k, 4.0) for k in range(12)], "item_id string, popularity long, average_rating double")
    history = rows_of(spark, [("u", f"i{k}", 5, "c", k) for k in (0, 1, 3, 9)] + [("v", "gone", 5, "c", 1)])
    got = {}
    for r in retrieval.global_popular(history, items, limit=3).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {"u": ["i2", "i4", "i5"], "v": ["i0", "i1", "i2"]}


def test_ranking_orders_by_raw_score_and_learned_order_can_flip_it(spark):
    from tastegrid.operators import ranking

    pool = spark.createDataFrame([("u", "a", {"co_visitation": 0.9}), ("u", "b", {"global_popular": 1.0}), ("new", "a", {})], "user_id string, item_id string, scores map<string,double>")
    users = spark.createDataFrame([("u", 0.9, ["soft"], ["loud"], ["c"], {"c": 0.5}, {"x": 0.5}, [1.0, 0.0])], "user_id string, confidence double, preferred_terms array<string>, disliked_terms array<string>, preferred_categories array<string>, category_affinity map<string,double>, aspects map<string,double>, vector array<double>")
    items = spark.createDataFrame([("a", "c", 0.5, 10, ["soft", "new"], {"x": 1.0}, [1.0, 0.0]), ("b", "d", 0.5, 20, ["loud"], None, None)], "item_id string, category string, quality_score double, popularity long, terms array<string>, aspects map<string,double>, vector array<double>")
    featured = {(r["user_id"], r["item_id"]): r for r in ranking.features(pool, users, items).collect()}
    a, b = featured["u", "a"], featured["u", "b"]
    assert (a["preference_match"], a["category_match"], a["vector_match"], a["collaborative_match"], a["aspect_match"], a["source_diversity"]) == (1.0, 1.0, 1.0, 0.9, 1.0, 0.25)
    assert (b["dislike_match"], b["vector_match"], b["retrieval_match"], b["popularity"]) == (1.0, 0.0, 0.38, 1.0)
    assert featured["new", "a"]["preference_match"] == 0 and featured["new", "a"]["confidence"] == 0.1
    ranked = ranking.rank(ranking.features(pool, users, items), 10)
    order = {r["item_id"]: r["rank"] for r in ranked.where("user_id = 'u'").collect()}
    assert order == {"a": 1, "b": 2}
    flipped = ranking.linear_rerank(ranked, {"popularity": 5.0, "preference_match": -5.0})
    assert {r["item_id"]: r["rank"] for r in flipped.where("user_id = 'u'").collect()} == {"a": 2, "b": 1}


def test_miss_causes(spark):
    ranked = spark.createDataFrame([("u", "a", "c", None), ("u", "b", "c", 3)], "user_id string, item_id string, category string, rank int")
    history = rows_of(spark, [("u", "x", 5, "c", 1)])
    train = rows_of(spark, [("v", "b", 5, "c", t) for t in range(4)])
    edges = spark.createDataFrame([("b", "z", 1.0)], "item_id string, neighbor_id string, score double")
    got = {}
    for r in evaluation.miss_causes(ranked, history, train, edges).collect():
        got.setdefault(r["item_id"], set()).add(r["cause"])
    assert got == {"a": {"target_absent_from_positive_train", "no_item_neighbor_path", "base_retrieval_miss"}, "b": {"ranker_miss"}}
