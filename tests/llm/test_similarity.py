"""Near-duplicates and cross-split overlaps against brute force, with the awkward inputs."""

import random
import re

import pytest

from tastegrid.llm import cross_split, near_dups
from tastegrid.llm import kernel as K

REVIEWS = "review_id string, user_id string, item_id string, review string, split_name string, cls long, a long, key string"


def _words(t):
    return re.findall("[a-z0-9]+", t.lower())


def _grams(w, k=3):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _texts(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.45:
            w = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.4:
                    w[at] = rng.choice(vocabulary)
                elif kind < 0.7:
                    w.insert(at, rng.choice(vocabulary))
                elif len(w) > 22:
                    del w[at]
            if rng.random() < 0.1:
                h = len(w) // 2
                w = w[h:] + w[:h]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 60))]
        out.append(w)
    return out


def _rows(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i, w in enumerate(_texts(rng, n)):
        text = rng.choice([" ", ", ", "  "]).join(w)
        rows.append((f"r{i:04}", f"u{i % 7}", f"i{i % 5}", text.upper() if rng.random() < 0.1 else text, rng.choice(["train", "train", "test_task_a", "test_task_b", "other"]), 1, 2, "x"))
    rows += [("n1", None, None, None, "train", 1, 2, "x"), ("n2", "u1", "i1", "", "train", 1, 2, "x"), ("n3", "u1", "i1", "!!!", "test_task_a", 1, 2, "x"), (None, "u1", "i1", "w1 " * 30, "train", 1, 2, "x")]
    rows += [("s1", "u1", "i1", "Short text", "train", 1, 2, "x"), ("s2", "u1", "i1", "short, text!", "test_task_a", 1, 2, "x"), ("s3", "u2", "i1", "short text", "test_task_a", 1, 2, "x"), ("s4", None, "i1", "short text", "test_task_b", 1, 2, "x"), ("s5", "u1", None, "short text", "train", 1, 2, "x")]
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(9999)) for _ in range(30_000))
    rows += [("l1", "u1", "i1", long, "train", 1, 2, "x"), ("l2", "u1", "i1", long + " tail", "test_task_b", 1, 2, "x")]
    return rows + rows[:20]


def _similar(a, b, k=3):
    return 2 * len(a & b) >= len(a | b)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = [r for r in _rows(seed) if r[4] == "train"]
    once = {r[0]: _words(r[3]) for r in rows if r[0] and r[3]}
    grams = {i: _grams(w) for i, w in once.items() if len(w) >= 20}
    ids = sorted(grams)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if _similar(grams[a], grams[b])}
    found = near_dups.find(spark.createDataFrame(rows, REVIEWS), "review_id", "review", shingle=3, similarity=0.5, min_words=20)
    got = {tuple(r) for r in near_dups.record_pairs(found).collect()}
    assert not got - want
    # banding misses at most 1.65 % of pairs exactly at the threshold
    assert len(want - got) <= max(1, 0.01 * len(want))
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want_groups = {i: root(i) for pair in got for i in pair}
    assert {r["rid"]: r["group_id"] for r in near_dups.groups(found).collect()} == want_groups
    stars = near_dups.find(spark.createDataFrame(rows, REVIEWS), "review_id", "review", shingle=3, similarity=0.5, min_words=20, all_pairs=False)
    assert {r["rid"]: r["group_id"] for r in near_dups.groups(stars).collect()} == want_groups
    tiles = near_dups.find(spark.createDataFrame(rows, REVIEWS), "review_id", "review", shingle=3, similarity=0.5, min_words=20, most=2)
    assert {tuple(r) for r in near_dups.record_pairs(tiles).collect()} == got


def test_short_copies_are_groups_and_every_record_has_a_row(spark):
    long = " ".join(f"w{i}" for i in range(30))
    texts = {"a": "Love it", "b": "love, it!", "c": "it love", "d": "love", "e": "LOVE", "f": "one two three four", "g": "one two three four five", "h": long, "i": long + " tail", "j": None, "k": "!!!", "l": "one two three four"}
    df = spark.createDataFrame([*texts.items(), (None, "love it"), ("a", "Love it")], "rid string, t string")
    found = near_dups.find(df, "rid", "t")
    got = {r["rid"]: r["group_id"] for r in near_dups.groups(found, df.select("rid")).collect()}
    partners = {"a": "a", "b": "a", "d": "d", "e": "d", "f": "f", "l": "f", "h": "h", "i": "h"}
    assert got == {i: i for i in texts} | partners
    assert {tuple(r) for r in near_dups.link_counts(found).collect()} == {(i, 1 if i in "hi" else 0) for i in partners}
    assert near_dups.groups(found, df.select("rid")).count() == len(texts)
    assert {r["rid"] for r in near_dups.groups(found).collect()} == set(partners)


def test_overlaps_equal_brute_force(spark):
    rows = _rows(3)
    once = {r[0]: r for r in rows if r[0] and r[3]}
    words = {i: _words(r[3]) for i, r in once.items()}
    want = set()
    for a, ra in once.items():
        for b, rb in once.items():
            if ra[4] in ("test_task_a", "test_task_b") and rb[4] == "train":
                wa, wb = words[a], words[b]
                if len(wa) >= 20 and len(wb) >= 20:
                    if _similar(_grams(wa), _grams(wb)):
                        want.add((a, b))
                elif 0 < len(wa) < 20 and wa == wb and ra[1] and ra[2] and ra[1:3] == rb[1:3]:
                    want.add((a, b))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, REVIEWS)
    got = cross_split.overlaps(df, "review_id", "review", F.col("split_name").startswith("test"), F.col("split_name") == "train", context=("user_id", "item_id")).collect()
    assert {(r[0], r[1]) for r in got} == want
    assert ("s2", "s1") in want and ("l2", "l1") in want
    exact = {(r[0], r[1]): r[2] for r in got}
    assert exact["s2", "s1"] == 0 and exact["l2", "l1"] == 1


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], REVIEWS)
    found = near_dups.find(none, "review_id", "review")
    assert near_dups.record_pairs(found).count() == 0 and near_dups.groups(found).count() == 0
    assert cross_split.overlaps(none, "review_id", "review", F.col("split_name") == "a", F.col("split_name") == "b").count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in near_dups.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}


def test_word_edits_equals_plain_dynamic_programming():
    import numpy as np

    rng, cases = random.Random(5), []
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            previous, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                previous, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, previous + (x != y))
        cases.append((a, b, d[-1]))
    for most in (0, 1, 3, 14):
        got = K.word_edits([np.array(a, np.uint64) for a, _, _ in cases], [np.array(b, np.uint64) for _, b, _ in cases], np.full(len(cases), most))
        assert got.tolist() == [d if d <= most else -1 for _, _, d in cases]


def test_bands_reach_the_promised_recall():
    for s in (0.5, 0.8):
        b = near_dups.bands_for(s)
        assert (1 - s**b.rows) ** b.bands <= 0.0165


def test_bands_miss_at_most_sixteen_in_a_thousand():
    for s in (0.5, 0.8):
        b = near_dups.bands_for(s)
        assert (1 - s**b.rows) ** b.bands <= 0.016


def test_a_large_bucket_of_a_template_is_linked_by_stars(spark):
    rng = random.Random(4)
    body = " ".join(f"t{i}" for i in range(60))
    rows = [(f"r{n:04}", f"{body} {rng.randrange(10**9)} {rng.randrange(10**9)}") for n in range(3000)] + [("s1", "only a few words"), ("s2", "Only a few WORDS!"), ("s3", "only a few other words")]
    df = spark.createDataFrame(rows, "rid string, t string")
    found = near_dups.find(df, "rid", "t", shingle=3, similarity=0.5, whole_below=20, all_pairs=False)
    assert found.links.count() < 10_000
    got = {r["rid"]: r["group_id"] for r in near_dups.groups(found, df.select("rid")).collect()}
    assert got == {r: "r0000" for r, _ in rows[:3000]} | {"s1": "s1", "s2": "s1", "s3": "s3"}


def test_overlap_of_a_short_text_with_an_edit_in_every_sixth_word_is_found(spark):
    from pyspark.sql import functions as F

    w = [f"w{i}" for i in range(20)]
    edited = [f"x{i}" if i in (1, 12, 13) else x for i, x in enumerate(w)]
    moved = w[15:] + w[10:15] + w[5:10] + w[:5]
    rows = [("e", " ".join(w), "test"), ("t1", " ".join(edited), "train"), ("t2", " ".join(moved), "train")]
    df = spark.createDataFrame(rows, "rid string, t string, s string")
    got = {r["train_id"]: r["similarity"] for r in cross_split.overlaps(df, "rid", "t", F.col("s") == "test", F.col("s") == "train").collect()}
    a, b = _grams(w), _grams(edited)
    assert got == {"t1": pytest.approx(len(a & b) / len(a | b)), "t2": 0.5}


def _fewest_whole_segments(n, size):
    """Fewest whole runs of ``size`` words over all ways to drop words and to cut and reorder blocks that leave half of the three-word runs common."""
    states = {(0, 0, 0): 0}  # (words of the running block up to size, words kept, common runs) -> whole segments
    for _ in range(n):
        following = {}
        for (block, kept, runs), whole in states.items():
            grown = min(block + 1, size)
            moves = [((0, kept, runs), whole), ((1, kept + 1, runs), whole)]
            if block:
                moves.append(((grown, kept + 1, runs + (grown >= 3)), whole + (block + 1 >= size)))
            for k, v in moves:
                following[k] = min(v, following.get(k, n))
        states = following
    return min(whole for (_, kept, runs), whole in states.items() if kept > 2 and 2 * runs >= n - 2 + kept - 2 - runs)


def test_more_segments_stay_whole_than_are_left_out():
    import numpy as np

    for n in (*range(20, 40), 47, 58):
        assert cross_split.left_out(np.array([n]))[0] < _fewest_whole_segments(n, cross_split.SEGMENT)
    assert cross_split.left_out(np.array([5, 19, 20, 58])).tolist() == [0, 3, 3, 16]


def test_segments_at_forbidden_positions_are_not_edits(spark):
    from pyspark.sql import functions as F

    w = [f"w{i}" for i in range(40)]
    moved, edited = w[20:] + w[:20], w[:10] + ["x"] + w[10:]
    rows = [("e", " ".join(w), "test"), ("moved", " ".join(moved), "train"), ("edited", " ".join(edited), "train"), ("cut", " ".join(w[:26]), "train")]
    df = spark.createDataFrame(rows, "rid string, t string, s string")
    for hot in (256, 0):
        got = {r["train_id"]: (r["word_edits"], r["similarity"]) for r in cross_split.overlaps(df, "rid", "t", F.col("s") == "test", F.col("s") == "train", hot=hot).collect()}
        assert got == {"moved": (None, pytest.approx(36 / 40)), "edited": (1, None), "cut": (None, pytest.approx(24 / 38))}
