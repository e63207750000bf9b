"""Every built source reaches the pool, and what did not run is told apart from zero."""

import os

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import evaluation, retrieval
from tastegrid.plans import engine_queries as Q
from tests.test_operators import rows_of
from tests.test_queries import SF

BUILT = {"co_visitation", "user_neighbor", "implicit_item_item", "review_term_profile", "lexical_item_neighbor", *retrieval.GRAPH_SOURCES, "bm25_profile", "category_affinity_popular", "global_popular", "aspect_profile", "sparse_category_tail"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_pool_holds_candidates_of_every_built_source(spark):
    history, catalogue, sources = Q._sources(spark, SF)
    assert set(sources) == BUILT
    merged = retrieval.merge(sources)
    named = {r[0] for r in merged.select(F.explode(F.map_keys("scores"))).distinct().collect()}
    assert named == BUILT
    assert merged.join(history, ["user_id", "item_id"], "left_semi").count() == 0
    kept = {r[0] for r in retrieval.pool(merged, catalogue).select(F.explode(F.map_keys("scores"))).distinct().collect()}
    assert kept >= {"review_term_profile", "lexical_item_neighbor", "bm25_profile", *retrieval.GRAPH_SOURCES}


def test_sources_that_did_not_run_are_null(spark):
    pool = spark.createDataFrame([("u", "a", 1, "co_visitation")], "user_id string, item_id string, rank int, source string")
    targets = spark.createDataFrame([("u", "a")], "user_id string, item_id string")
    got = {r["source"]: r for r in evaluation.source_diagnostics(pool, targets, {"co_visitation", "user_neighbor"}).collect()}
    assert (got["co_visitation"]["ran"], got["co_visitation"]["hits_50"], got["co_visitation"]["recall_50"]) == (True, 1, 1.0)
    assert (got["user_neighbor"]["ran"], got["user_neighbor"]["n_candidates"], got["user_neighbor"]["recall_50"]) == (True, 0, 0.0)
    assert (got["neural_vector"]["ran"], got["neural_vector"]["n_candidates"], got["neural_vector"]["recall_50"]) == (False, None, None)


def test_graph_budget_follows_the_history(spark):
    graph = spark.createDataFrame([(u, f"i{k:02}", 1 - k / 100, Q.retrieval.GRAPH_SOURCES[k % 2], k + 1) for u in "uv" for k in range(72)], "user_id string, item_id string, score double, source string, rank int")
    history = rows_of(spark, [("u", "x", 5, "c", 1)] + [("v", f"y{k}", 5, "c", k) for k in range(3)])
    parts = retrieval.graph_sources(graph, history)
    counts = {(n, r["user_id"]): r["count"] for n, f in parts.items() for r in f.groupBy("user_id").count().collect()}
    assert counts == {("sequential_transition", "u"): 24, ("category_transition", "u"): 24, ("sequential_transition", "v"): 18, ("category_transition", "v"): 18}
    assert parts["category_transition"].agg(F.min("rank"), F.max("rank")).first() == (1, 24)


def test_bm25_takes_unseen_items_only(spark):
    index = spark.createDataFrame([(f"i{k}", "t", 9 - k, 10, 1.0, 10.0) for k in range(5)], "item_id string, term string, tf int, dl int, idf double, avgdl double")
    words = spark.createDataFrame([("u", "t", 1)], "user_id string, term string, times int")
    history = rows_of(spark, [("u", "i0", 5, "c", 1), ("u", "i1", 5, "c", 2)])
    got = {r["item_id"]: (r["rank"], r["score"]) for r in retrieval.bm25(words, index, 2, history).collect()}
    assert {k: v[0] for k, v in got.items()} == {"i2": 1, "i3": 2} and got["i2"][1] < 1.0


def test_ablation_masks():
    assert set(Q.ABLATIONS) == {"lean", "no_implicit_item_item", "no_co_visitation", "no_user_neighbor", "no_collaborative", "no_review_terms", "no_evidence_graph", "no_aspect_taxonomy", "no_popularity_fallback"}


def test_mixer_stages(spark):
    """Floors come first, protected candidates leave room, exploring ones fill it, the rest follows."""
    rows = [("u", f"p{k:03}", {"implicit_item_item": 1 - k / 200}, 1, 0.9 - k / 1000) for k in range(120)] + [("u", f"x{k:03}", {"aspect_profile": 0.9}, 1, 0.5 - k / 1000) for k in range(30)] + [("u", f"g{k:03}", {"global_popular": 0.2}, 1, 0.1) for k in range(25)]
    merged = spark.createDataFrame(rows, "user_id string, item_id string, scores map<string,double>, n_sources int, priority double")
    items = merged.select("item_id", F.lit(1).alias("popularity"), F.lit(4.0).alias("average_rating"))
    history = rows_of(spark, [("u", f"h{k}", 5, "c", k) for k in range(3)])
    got = {r["item_id"]: (r["rank"], r["stage"]) for r in retrieval.mix(merged, items, history).collect()}
    assert len(got) == 100 and {r for r, _ in got.values()} == set(range(1, 101))
    assert sorted(i for i, (_, s) in got.items() if s == 2) == sorted(f"p{k:03}" for k in range(8))  # eight best of the floor of one source
    assert sum(s == 4 for _, s in got.values()) == 20  # popular floor
    assert sum(s == 6 for _, s in got.values()) == 90 - 28 and sum(s == 7 for _, s in got.values()) == 10


def test_pair_sums_equal_brute_force(spark):
    from collections import defaultdict
    from itertools import combinations

    from tastegrid.operators import gram

    cells = [(f"u{r}", c, float((r * c) % 7 + 1)) for r in range(30) for c in range(40) if (r + c * c) % 3 or r == 0]
    by = defaultdict(dict)
    for r, c, v in cells:
        by[r][c] = v
    want = defaultdict(float)
    for row in by.values():
        for a, b in combinations(sorted(row), 2):
            want[a, b] += row[a] * row[b]
    for piece in (500, 7):
        got = gram.pair_sums(spark.createDataFrame(cells, "u string, c long, v double"), "u", "c", "v", piece).collect()
        assert {(r["a"], r["b"]): r["dot"] for r in got} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_sources_are_stored_once(spark):
    """fill and merge each computed every source anew."""
    _, _, sources = Q._sources(spark, SF)
    for frame in sources.values():
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" not in plan and "Window" not in plan
