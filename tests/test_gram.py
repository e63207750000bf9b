"""Cosine neighbours where two users hold nearly every item."""

import math
import random

from tastegrid.operators import gram, indexes, retrieval
from tests.test_operators import rows_of


def test_long_rows_are_searched_and_not_listed(spark, monkeypatch):
    """all pairs of the items of a user with many items were listed."""
    rng = random.Random(7)
    triples = [(u, f"i{i:03}", rng.randint(1, 5), "c", i) for u, n in (("hot", 200), ("warm", 150), ("tepid", 60)) for i in rng.sample(range(220), n)]
    triples += [(f"u{u}", f"i{i:03}", rng.randint(3, 5), "c", i) for u in range(60) for i in rng.sample(range(220), 4)]
    rows = rows_of(spark, triples)
    items = spark.createDataFrame([(f"i{k:03}",) for k in range(220)], "item_id string")
    want = sorted(map(tuple, indexes.cosine_neighbors(rows, items, k=9, per_user=500).collect()))
    listed = []
    whole = gram.pair_sums
    monkeypatch.setattr(gram, "pair_sums", lambda cells, *a, **k: listed.append(cells.count()) or whole(cells, *a, **k))
    got = sorted(map(tuple, indexes.cosine_neighbors(rows, items, k=9, per_user=20).collect()))
    assert got == want and got
    assert listed == [240]


def test_fewer_dense_rows_than_long_ones(spark, monkeypatch):
    rng = random.Random(8)
    rows = rows_of(spark, [(f"u{u}", f"i{i:02}", rng.randint(1, 5), "c", i) for u in range(6) for i in rng.sample(range(40), 30)])
    items = spark.createDataFrame([(f"i{k:02}",) for k in range(40)], "item_id string")
    want = sorted(map(tuple, indexes.cosine_neighbors(rows, items, k=5, per_user=500).collect()))
    monkeypatch.setattr(gram, "MOST_DENSE", 2)
    assert sorted(map(tuple, indexes.cosine_neighbors(rows, items, k=5, per_user=10).collect())) == want


def test_votes_are_added_up_inside_the_task(spark):
    """F8: the votes were joined with every neighbour and shuffled."""
    history = rows_of(spark, [("u", "a", 5, "c", 1), ("u", "b", 4, "c", 2)])
    edges = spark.createDataFrame([("a", "x", 0.5, 1), ("b", "x", 0.5, 1), ("b", "y", 0.25, 2), ("a", "b", 0.9, 2)], "item_id string, neighbor_id string, score double, rank int")
    found = retrieval.implicit_items(history, edges)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [("u", "x", 1.0, 1), ("u", "y", round(0.5 * 0.25 / (0.5 * 0.5 + 1 / math.sqrt(2) * 0.5), 4), 2)]
