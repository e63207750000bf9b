"""Leakage, look-alikes and mixtures against brute force, with the awkward inputs."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tastegrid.llm import leakage, lookalike, mixture

DOCS = "doc_id long, text string"


def _longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else 0)
        best, row = max(best, *new), new
    return best


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_equal_brute_force(spark, most):
    rng = random.Random(9)
    words = ["été", "ёж", "alpha", "beta", "gamma", "delta", "x1", "2", "über"]
    tests = [[rng.choice(words) for _ in range(rng.randint(5, 60))] for _ in range(25)]
    docs = []
    for i in range(120):
        d = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            p = rng.choice(tests)
            a = rng.randrange(len(p))
            d[3:3] = p[a : a + rng.randint(8, 40)]
        docs.append(d)
    docs.append([rng.choice(words) for _ in range(20_000)] + tests[0])
    rows = [(i, " ".join(d).replace("a", "а") if i % 3 == 0 else ", ".join(d).upper() if i % 3 == 1 else "  ".join(d)) for i, d in enumerate(docs)]
    rows += [(900, None), (901, ""), (None, " ".join(tests[0])), rows[0]]
    passages = [(100 + i, " ".join(p)) for i, p in enumerate(tests)] + [(500, None), (501, " "), (100, " ".join(tests[0]))]
    want = {(i, 100 + j) for i, d in enumerate(docs) for j, p in enumerate(tests) if _longest(d, p) >= 13}
    df, pf = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)), spark.createDataFrame(passages, "passage_id long, text string")
    got = leakage.leaks(df, "doc_id", "text", pf, "passage_id", "text", max_test_words=most)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    assert leakage.leaks(df.limit(0), "doc_id", "text", pf, "passage_id", "text", max_test_words=most).count() == 0
    assert leakage.leaks(df, "doc_id", "text", pf.limit(0), "passage_id", "text", max_test_words=most).count() == 0


def test_one_form(spark):
    same = [
        ["Café au lait", "Café au lait", "Ｃafé au lait", "Саfé аu l​ait", "C­afе́ au　lait"],
        ["naïve—ok", "naïve—ok", "nаїve—ok"],
        ["plain", "pl﻿ain", "plаin"],
    ]
    different = ["Cafe au lait", "café au lait", "Cafë au lait", "plain1", "p1ain", "PLAIN", "plain", " ", "", "​", None, "привет", "0O", "O0"]
    rewriter = lookalike.Rewriter(lookalike.rewriting({}))
    for group in same:
        assert len({rewriter(t) for t in group}) == 1, [rewriter(t) for t in group]
    forms = [rewriter(t) for t in different if t]
    assert len(set(forms)) == len(forms)
    assert all(rewriter(rewriter(t)) == rewriter(t) for g in same for t in g)
    rows = [(i, t) for i, t in enumerate(t for g in same for t in g)] + [(100 + i, t) for i, t in enumerate(different)] + [(None, "plаin"), (0, same[0][0])]
    got = {tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, DOCS).withColumn("one", F.lit(1)), "doc_id", "text").collect()}
    want, by = set(), {}
    for i, t in rows:
        if i is not None and t and rewriter(t).strip():
            by.setdefault(rewriter(t), []).append((i, t))
    for g in by.values():
        want |= {(a, b) for a, x in g for b, y in g if a < b and x != y}
    assert got == want and len(want) >= 14
    empty = spark.createDataFrame([], DOCS)
    assert lookalike.lookalike_pairs(empty, "doc_id", "text").count() == 0 and lookalike.canonical(empty, "doc_id", "text").count() == 0
    assert dict(map(tuple, lookalike.canonical(spark.createDataFrame([(1, None), (2, "")], DOCS), "doc_id", "text").collect())) == {1: None, 2: ""}


def test_representatives_follow_frequency_and_stay_closed():
    counts = {"ё": 900, "ë": 1, "е": 5000, "e": 10, "о": 50, "o": 5, "̈": 3, "a": 7}
    rewriter = lookalike.Rewriter(lookalike.rewriting(counts))
    assert rewriter("e") == "е" and rewriter("o") == "о" and rewriter("Ａ") == "A"
    assert rewriter("ë") == rewriter("ë") == rewriter("ё") == rewriter("e​̈") == "ё"
    assert unicodedata.normalize("NFC", rewriter("ö")) == rewriter("ö")


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(10)
    rows = [(i, "word " * rng.randint(1, 60), rng.choice(["big", "Big", "big ", "mid", "small"][: 4 if rng.random() < 0.97 else 5])) for i in range(4000)]
    rows += [(9001, None, "big"), (9002, "", "mid"), (9003, "text", None), (9004, "text", "unlisted"), (None, "text", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(3))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mixture.mixture(df, targets)
    caps = {"big": 1, "mid": 2, "small": 3}
    rows = drawn.collect()
    assert rows and all(0 < r["copies"] <= caps[r["source"]] for r in rows) and len({r["id"] for r in rows}) == len(rows)
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"big", "mid", "small", "absent"} and by["absent"]["share"] == 0
    assert sum(r["share"] for r in by.values()) == pytest.approx(1)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert by[s]["share"] == pytest.approx(share / 0.9, rel=0.06), by[s]
        assert by[s]["tokens_drawn"] == sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
    drawn, report = mixture.mixture(df.limit(0), targets)
    assert drawn.count() == 0 and all(r["share"] == 0 for r in report.collect())
    with_total, _ = mixture.mixture(df, targets, total_tokens=5000)
    assert with_total.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] == pytest.approx(5000, rel=0.1)


def test_token_counts_equal_the_tokenizer(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixture.TOKENIZER, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "été 🎉 слово", "<|endoftext|> x", "a" * 5000, " \n\n ", "don't 12345"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = mixture.token_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    assert {r["id"]: r["tokens"] for r in got} == {i: len(encoding.encode_ordinary(t)) for i, t in enumerate(texts)}
