"""Co-occurrence, top-N, distinctive terms and vectors against brute force, with the awkward inputs."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import cooccurrence, distinctive, topn, vectors


def _baskets(rng, n_users, n_items, size):
    rows = []
    for u in range(n_users):
        start = rng.randrange(n_items)
        rows += [(f"u{u}", f"i{(start + rng.randrange(8)) % n_items:03}", 5.0) for _ in range(rng.randint(1, size))]
    return rows


@pytest.mark.parametrize("wide,hot", [(512, 0), (5, 0), (5, 3), (30, 2), (30, 6)])
def test_cooccurrence_equals_brute_force(spark, wide, hot):
    rng = random.Random(wide + hot)
    rows = _baskets(rng, 150, 120, 9)
    for h in range(hot):
        rows += [(f"hot{h}", f"i{i:03}", 4.0) for i in range(0, 120, 1 + h % 3)]
    rows += [(None, "i001", 5.0), ("u1", None, 5.0), ("u1", "i002", None), *rows[:30]]
    baskets = defaultdict(set)
    for u, i, r in rows:
        if u and i and r:
            baskets[u].add(i)
    n, ab = Counter(), Counter()
    for b in baskets.values():
        n.update(b)
        ab.update(combinations(sorted(b), 2))
    want = {(a, b, c, n[a], n[b]) for (a, b), c in ab.items() if c >= 4 and c * len(baskets) >= 5 * n[a] * n[b]}
    df = spark.createDataFrame(rows, "basket string, item string, rating double").withColumn("i", F.lit(0)).where("rating is not null")
    got = cooccurrence.cooccurrence(df, F.col("basket"), F.col("item"), wide=wide)
    assert {tuple(r)[:5] for r in got.collect()} == want and want
    assert cooccurrence.cooccurrence(df.limit(0), F.col("basket"), F.col("item")).count() == 0


def test_top_n_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(60)}", f"n{rng.randrange(40):02}", round(rng.random(), 1)) for _ in range(1500)]
    rows += [("hot", f"n{i:05}", float(i % 977)) for i in range(5000)] + [("hot", "n00001", 2000.0)] * 3 + [("same", f"n{i}", 1.0) for i in range(500)]
    rows += [(None, "n1", 1.0), ("g1", None, 9.0), ("g1", "n1", None), ("g1", "n2", float("nan")), ("g1", "g1", 99.0), ("neg", "n1", -5.0), ("neg", "n2", float("-inf"))]
    best = defaultdict(dict)
    for g, i, s in rows:
        if g and i and s is not None and not math.isnan(s) and g != i:
            best[g][i] = max(s, best[g].get(i, -math.inf))
    want = {(g, i, s, k) for g, d in best.items() for k, (i, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:10], 1)}
    df = spark.createDataFrame(rows, "item_id string, neighbor_id string, score double").withColumn("rank", F.lit(1)).withColumn("grp", F.lit("x"))
    for size in (50, 20_000):
        got = topn.top_n(df, "item_id", "neighbor_id", "score", 10, row_group_rows=size)
        assert {tuple(r) for r in got.collect()} == want
    listed, read = topn.row_groups_read(df, "item_id", "neighbor_id", "score", 10, row_group_rows=50)
    assert listed > 100 and read < listed - 80  # the row groups of the group "hot" below its tenth score stay unread
    assert topn.top_n(df.limit(0), "item_id", "neighbor_id", "score", 10).count() == 0


def test_term_counts_and_weights(spark):
    rng = random.Random(6)
    words = ["Ab", "abc", "the-end", "x9_z", "9nine", "naïve", "__under", "a-", "long" * 5000, "term"]
    rows = [(f"r{i}", f"i{rng.randrange(12) if rng.random() < 0.6 else 0}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(3000)]
    rows += [("n1", None, "abc abc"), ("n2", "i1", None), ("n3", "i2", ""), (None, "i3", "term term"), (None, "i3", "term term")] + rows[:50]
    once, tf, reviews = set(), Counter(), Counter()
    for r, i, t in rows:
        if i and t is not None and (r is None or r not in once):
            once.add(r)
            found = re.findall(r"[a-z][a-z0-9_-]{2,}", t.lower())
            tf.update((i, x) for x in found)
            reviews.update((i, x) for x in set(found))
    df = spark.createDataFrame(rows, "id string, item string, text string").withColumn("tf", F.lit(1))
    counts = distinctive.term_counts(df, "id", "item", "text").collect()
    assert {(r["item"], r["term"]): (r["tf"], r["reviews"]) for r in counts} == {k: (v, reviews[k]) for k, v in tf.items()}
    got = distinctive.term_weights(df, "id", "item", "text").collect()
    n = len({i for i, _ in tf})
    df_of, cf, dl = Counter(x for _, x in tf), Counter(), Counter()
    for (i, x), v in tf.items():
        cf[x] += v
        dl[i] += v
    avg = sum(dl.values()) / n
    for r in got:
        k = (r["item"], r["term"])
        tfn = tf[k] * math.log2(1 + avg / dl[k[0]])
        rate = cf[k[1]] / n
        assert r["dfr_weight"] == pytest.approx((math.log2(1 + rate) + tfn * math.log2(1 + 1 / rate)) / (1 + tfn))
        assert r["idf_weight"] == pytest.approx((1 + math.log(tf[k])) * math.log(1 + n / (1 + df_of[k[1]])))
    assert len(got) == len(tf)
    assert distinctive.term_weights(df.limit(0), "id", "item", "text").count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PACK_ROWS", 128)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16)) * rng.uniform(0.01, 50, (700, 1))
    x[300:340] = x[200:240] * 2 + rng.normal(size=(40, 16)) * 0.01
    x[400] = x[401]
    rows = [(f"u{i:03}", v.tolist(), 1) for i, v in enumerate(x)]
    bad = [("b1", None), ("b2", []), ("b3", [0.0] * 16), ("b4", [1.0] * 15), ("b5", [float("nan")] * 16), ("b6", [None, *[1.0] * 15]), (None, [1.0] * 16), ("b7", [float("inf")] * 16)]
    rows += [(i, v, 1) for i, v in bad] + rows[:20]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    df = spark.createDataFrame(rows, "id string, v array<double>, similarity int")
    got = defaultdict(dict)
    for r in vectors.most_similar(df, "id", "v", 5, dim=16, order_col="similarity").collect():
        got[r["id"]][r["neighbor_id"]] = r["similarity"]
    assert len(got) == 700
    for i in range(700):
        want = np.sort(s[i])[::-1][:5]
        assert np.allclose(sorted(got[f"u{i:03}"].values(), reverse=True), want)
        assert all(abs(s[i, int(n[1:])] - v) < 1e-9 for n, v in got[f"u{i:03}"].items())
    near = vectors.most_similar(df, "id", "v", 5, dim=16, min_similarity=0.9).collect()
    assert {(r["id"], r["neighbor_id"]) for r in near} == {(f"u{i:03}", f"u{j:03}") for i, j in zip(*np.nonzero(s >= 0.9))}
    assert vectors.most_similar(df.limit(0), "id", "v", 5, dim=16).count() == 0


def test_packs_of_far_clusters_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PACK_ROWS", 64)
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(16)[:8], 64, axis=0) + rng.normal(size=(512, 16)) * 0.05
    rows = [(f"u{i:03}", v.tolist()) for i, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = vectors.most_similar(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 3, dim=16).collect()
    assert len(got) == 3 * 512
    for r in got:
        assert s[int(r["id"][1:]), int(r["neighbor_id"][1:])] >= np.sort(s[int(r["id"][1:])])[-3] - 1e-9
    packs = [vectors.Pack("", i, 64, c := u[64 * i : 64 * i + 64].mean(axis=0) / np.linalg.norm(u[64 * i : 64 * i + 64].mean(axis=0)), float(np.arccos((u[64 * i : 64 * i + 64] @ c).min()))) for i in range(8)]
    assert all(vectors.reachable(packs, i, 0.9) == [] for i in range(8)) and all(len(vectors.reachable(packs, i, -1)) == 7 for i in range(8))
