"""Candidate sources: (user_id, item_id, score, rank) per source, and their merge into one pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions import text as T
from tastegrid.functions.words import ASPECT_STOPWORDS, FAMILY_CONFIDENCE, REVIEW_STOPWORDS, SOURCES
from tastegrid.operators import indexes, scoring, stats, tokens
from tastegrid.operators.indexes import top
from tastegrid.plans.scratch import write_table


def seed_weight(rating: Column) -> Column:
    return F.greatest((rating - 3.0) / 2.0, F.lit(0.1))


def normalised(scores: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` per user by raw score, as a share of the user's maximum, four places."""
    order = Window.partitionBy("user_id").orderBy(F.desc("raw"), "item_id")
    kept = scores.withColumn("raw", F.round("raw", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    peak = F.first("raw").over(order)
    return kept.withColumn("score", F.round(F.least(F.col("raw") / F.when(peak != 0, peak).otherwise(1.0), F.lit(1.0)), 4)).select("user_id", "item_id", "score", "rank")


def unseen(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates outside the user's history."""
    return candidates.join(history.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def co_visitation(history: DataFrame, neighbors: DataFrame, limit: int = 35) -> DataFrame:
    """Weighted neighbours of liked items; the budget is cut before seen items leave."""
    seeds = history.where("rating >= 4").select("user_id", F.col("item_id").alias("seed"), seed_weight(F.col("rating")).alias("w"))
    raw = seeds.join(neighbors.select(F.col("item_id").alias("seed"), "neighbor_id", "score"), "seed").groupBy("user_id", F.col("neighbor_id").alias("item_id")).agg(F.sum(F.col("w") * F.col("score")).alias("raw"))
    return unseen(normalised(raw, limit), history)


def implicit_items(history: DataFrame, neighbors: DataFrame, limit: int = 42, seeds: int = 12, per_seed: int = 120) -> DataFrame:
    """Votes of the latest liked items, by rating and recency, over their cosine neighbours."""
    liked = top(history.where("rating >= 4"), ["user_id"], [F.desc("ts"), F.desc("rating"), F.desc("item_id"), F.desc("review_id")], seeds, "i")
    votes = liked.select("user_id", F.col("item_id").alias("key"), (F.greatest((F.col("rating") - 3) / 2, F.lit(0.25)) / F.sqrt(F.col("i").cast("double"))).alias("w"))
    spark = neighbors.sparkSession
    edges = neighbors.where(F.col("rank") <= per_seed).select(F.col("item_id").alias("key"), F.col("neighbor_id").alias("item_id"), F.col("score").alias("value"))
    edges = spark.read.parquet(write_table(edges, "edges", compression="zstd"))
    return scoring.best_sums(votes, scoring.write_index(edges, edges.select("item_id").distinct(), edges.count()), limit, history)


def user_neighbors(history: DataFrame, item_users: DataFrame, user_items: DataFrame, limit: int = 35, most: int = 200) -> DataFrame:
    """Two hops: liked items to their users (best ``most``), to those users' items."""
    seeds = history.where("rating >= 4").select("user_id", "item_id", seed_weight(F.col("rating")).alias("w"))
    hop = seeds.join(item_users.select("item_id", F.col("user_id").alias("other"), "weight"), "item_id").groupBy("user_id", "other").agg(F.round(F.sum(F.col("w") * F.col("weight")), 9).alias("s"))
    near = top(hop, ["user_id"], [F.desc("s"), "other"], most)
    reach = near.select("user_id", "other", "s").join(user_items.select(F.col("user_id").alias("other"), "item_id", "weight"), "other")
    raw = unseen(reach.groupBy("user_id", "item_id").agg(F.sum(F.col("s") * F.col("weight")).alias("raw")), history)
    return normalised(raw, limit)


def query_terms(history: DataFrame, item_terms: DataFrame, most: int = 28) -> DataFrame:
    """(user_id, term, w): the words of a user's reviews from 3 stars and of their items."""
    used = history.where("rating >= 3").withColumn("w", F.greatest((F.col("rating") - 2) / 3, F.lit(0.2)))
    listed = item_terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "score")).alias("about"))
    none = F.array().cast("array<struct<term: string, score: double>>")
    said = used.select("user_id", "w", T.join_parts(F.col("name"), F.col("category"), F.col("review")).alias("said"), none.alias("about"))
    rows = said.unionByName(used.select("user_id", "item_id", "w").join(listed, "item_id").select("user_id", "w", F.lit(None).cast("string").alias("said"), "about"))
    scoring.ship_package(history.sparkSession)

    def heaviest(part: DataFrame) -> DataFrame:
        columns = ("user_id", F.col("w").cast("double"), "said", F.col("about.term").alias("words"), F.col("about.score").alias("values"))
        return part.sortWithinPartitions("user_id").select(*columns).mapInArrow(tokens.heaviest_words(most, REVIEW_STOPWORDS), "user_id string, term string, w double")

    def sums(part: DataFrame) -> DataFrame:
        words = F.transform(T.review_terms(F.col("said")), lambda t: F.struct(t.alias("term"), F.col("w").cast("double").alias("w")))
        known = F.transform("about", lambda x: F.struct(x["term"].alias("term"), (F.col("w") * x["score"]).alias("w")))
        found = part.select("user_id", F.explode(F.concat(words, known)).alias("e")).groupBy("user_id", F.col("e.term").alias("term")).agg(F.round(F.sum("e.w"), 9).alias("w"))
        return top(found, ["user_id"], [F.desc("w"), "term"], most).drop("rank")

    return stats.within_users(rows, heaviest, heavy=sums)


def _term_index(item_terms: DataFrame, posted: DataFrame, items: DataFrame | None = None) -> scoring.Index:
    """Postings written for sums, beside the category of each item of ``items``."""
    named = item_terms.select("item_id").distinct()
    return scoring.write_index(posted.select(F.col("term").alias("key"), "item_id", F.col("posting").alias("value")), named if items is None else named.join(items.select("item_id", "category"), "item_id", "left"), item_terms.count())


def review_terms(history: DataFrame, item_terms: DataFrame, posted: DataFrame, preferred: DataFrame, items: DataFrame, limit: int = 38) -> DataFrame:
    """History words against postings; items of a preferred category count 1.16 times."""
    asked = query_terms(history, item_terms).select("user_id", F.col("term").alias("key"), "w")
    return scoring.best_sums(asked, _term_index(item_terms, posted, items), limit, history, preferred, 1.16)


def lexical_neighbors(history: DataFrame, item_terms: DataFrame, posted: DataFrame, limit: int = 30, per_item: int = 12) -> DataFrame:
    """Items that share the leading terms of liked items."""
    seeds = history.where("rating >= 4").select("user_id", "item_id", seed_weight(F.col("rating")).alias("w"))
    lead = item_terms.where(F.col("rank") <= per_item).groupBy("item_id").agg(F.collect_list(F.struct("term", "score")).alias("about"))

    def sums(part: DataFrame) -> DataFrame:
        return part.select("user_id", "w", F.explode("about").alias("e")).groupBy("user_id", F.col("e.term").alias("key")).agg(F.sum(F.col("w") * F.col("e.score")).alias("w"))

    return scoring.best_sums(stats.within_users(seeds.join(lead, "item_id").select("user_id", "w", "about"), sums), _term_index(item_terms, posted), limit, history)


def evidence_graph(history: DataFrame, transitions: DataFrame, aspects: DataFrame, category_aspects: DataFrame, user_aspects: DataFrame, preferred: DataFrame, limit: int = 72) -> DataFrame:
    """Sum over four kinds of edges; ``source`` names the kind with the largest single contribution."""
    latest = top(history.where("rating >= 4"), ["user_id"], [F.desc("ts"), F.desc("review_id")], 4)
    active = user_aspects.where("score > 0").select("user_id", "aspect", F.col("score").alias("w"))

    def key(source: str, *columns: str) -> Column:
        return F.concat_ws("\u0001", F.lit(source), *columns).alias("key")

    both = active.join(preferred.where("rank <= 4").select("user_id", "category"), "user_id")
    kinds = {
        "sequential_transition": (transitions.where("kind = 'item'").withColumnRenamed("dst", "item_id"), latest.select("user_id", F.col("item_id").alias("src"), F.lit(0.92).alias("w")), ["src"]),
        "category_transition": (transitions.where("kind = 'category'").withColumnRenamed("dst", "item_id"), latest.select("user_id", F.col("category").alias("src"), F.lit(0.58).alias("w")), ["src"]),
        "aspect_evidence_graph": (aspects, active, ["aspect"]),
        "category_aspect_graph": (category_aspects, both.withColumn("w", 1.18 * F.col("w")), ["aspect", "category"]),
    }
    edges = queries = None
    for name, (found, asked, columns) in kinds.items():
        e, q = found.select(key(name, *columns), "item_id", F.col("score").alias("value")), asked.select("user_id", key(name, *columns), "w", F.lit(name).alias("source"))
        edges, queries = (e, q) if edges is None else (edges.unionByName(e), queries.unionByName(q))
    spark = edges.sparkSession
    edges = spark.read.parquet(write_table(edges, "edges", compression="zstd"))
    index = scoring.write_index(edges, edges.select("item_id").distinct(), edges.count())
    return scoring.best_strongest(queries, index, history, tuple(kinds), limit)


GRAPH_SOURCES = ("sequential_transition", "category_transition", "aspect_evidence_graph", "category_aspect_graph")


def graph_sources(graph: DataFrame, history: DataFrame, budget: int = 36, sparse_budget: int = 48) -> dict[str, DataFrame]:
    """The first ``budget`` graph candidates of a user (``sparse_budget`` at two history rows or fewer), apart by source and ranked within it."""
    sizes = history.groupBy("user_id").agg(F.when(F.count("*") <= 2, sparse_budget).otherwise(budget).alias("budget"))
    kept = graph.join(sizes, "user_id").where("rank <= budget")
    order = Window.partitionBy("user_id", "source").orderBy("rank")
    placed = kept.withColumn("rank", F.row_number().over(order)).select("user_id", "item_id", "score", "rank", "source")
    placed = graph.sparkSession.read.parquet(write_table(placed, "graph", compression="zstd"))
    return {name: placed.where(F.col("source") == name).drop("source") for name in GRAPH_SOURCES}


def bm25(queries: DataFrame, index: DataFrame, limit: int = 35, history: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, score, rank) for ``queries(user_id, term, times)``; repeated query terms count repeatedly.

    With ``history``, the first ``limit`` outside it, still as shares of the best item of all.
    """
    score = indexes.bm25_score(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"))
    spark = index.sparkSession
    posted = spark.read.parquet(write_table(index.select(F.col("term").alias("key"), "item_id", score.alias("value")), "bm25", compression="zstd"))
    written = scoring.write_index(posted, posted.select("item_id").distinct(), posted.count())
    return scoring.best_sums(queries.select("user_id", F.col("term").alias("key"), F.col("times").alias("w")), written, limit, history, peak_of_all=True)


def preferred_categories(history: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, category, n, rank): categories by liked items, or by all where nothing was liked; ties by first use."""
    counts = history.groupBy("user_id", "category").agg(F.sum((F.col("rating") >= 4).cast("long")).alias("liked"), F.count("*").alias("all"), F.min(F.struct("ts", "review_id")).alias("first"))
    some = F.max("liked").over(Window.partitionBy("user_id")) > 0
    used = counts.withColumn("n", F.when(some, F.col("liked")).otherwise(F.col("all"))).where("n > 0")
    return top(used, ["user_id"], [F.desc("n"), "first", "category"], most).select("user_id", "category", "n", "rank")


def _log_share(n: Column, most: Column) -> Column:
    return F.when((n > 0) & (most > 0), F.log1p(n.cast("double")) / F.log1p(most.cast("double"))).otherwise(0.0)


def popularity_order() -> list[Column]:
    return [F.desc("popularity"), F.desc(F.coalesce("average_rating", F.lit(0.0))), F.desc("item_id")]


def category_weights(history: DataFrame) -> DataFrame:
    """(user_id, category, cw, r): weight of each preferred category by its place r and by affinity."""
    affinity = history.groupBy("user_id", "category").agg(((F.avg("rating") - 3) / 2).alias("affinity"))
    weight = F.greatest(F.greatest(1 - 0.08 * (F.col("r") - 1), F.lit(0.65)), F.least(0.65 + F.coalesce("affinity", F.lit(0.0)), F.lit(1.0)))
    return preferred_categories(history).withColumnRenamed("rank", "r").join(affinity, ["user_id", "category"], "left").select("user_id", "category", weight.alias("cw"), "r")


def quality() -> Column:
    """Share of the best rating; 3.5 stars where there is none."""
    return F.coalesce(F.nullif("average_rating", F.lit(0.0)), F.lit(3.5)) / 5


def quality_popularity() -> Column:
    return F.round(F.least(F.when(F.col("popularity") > 0, 0.70 * quality() + 0.30).otherwise(quality()), F.lit(1.0)), 4)


def aspect_profile(history: DataFrame, liked: DataFrame, items: DataFrame, per_token: int = 300, budget: int = 16, sparse_budget: int = 26) -> DataFrame:
    """Items of weighted categories that hold a user's liked terms: 0.50 postings (1/sqrt of the place by popularity), 0.24 share of the terms,
    0.16 quality, 0.10 log popularity; ``liked(user_id, term)``."""
    terms = F.array_distinct(T.terms(indexes.item_text()))
    words = items.select("item_id", "category", "popularity", F.coalesce("average_rating", F.lit(0.0)).alias("rating"), "average_rating", (0.16 * quality()).alias("q"), (0.10 * indexes.popularity_score(F.col("popularity"), 500)).alias("p"), terms.alias("terms"))
    key = F.concat("category", F.lit("\u0001"), "term").alias("key")
    posted = top(words.select("category", F.explode("terms").alias("term"), "item_id", "popularity", "average_rating"), ["category", "term"], popularity_order(), per_token, "place").select(key, "item_id", (1 / F.sqrt(F.col("place").cast("double"))).alias("value"))
    size = words.agg(F.sum(F.size("terms"))).first()[0] or 0
    index = scoring.write_index(posted, words.select("item_id", "popularity", "rating", "q", "p", "terms"), size)
    useful = liked.where(~F.col("term").isin(ASPECT_STOPWORDS)).select("user_id", "term").distinct()
    asked = useful.join(category_weights(history), "user_id").select("user_id", key, F.col("cw").alias("w"))
    return scoring.best_profile(asked, useful, index, history, per_token, budget, sparse_budget)


def sparse_tail(history: DataFrame, items: DataFrame, window: int = 2000, picks: int = 12, budget: int = 8) -> DataFrame:
    """For users of at most two history rows: evenly spaced items among the first ``window`` of each weighted category."""
    ranked = top(items, ["category"], popularity_order(), window, "place")
    sizes = ranked.groupBy("category").agg(F.greatest(F.lit(1), F.floor(F.count("*") / picks)).alias("stride"))
    at = F.col("place") - 1
    chosen = ranked.join(sizes, "category").where((at % F.col("stride") == 0) & (at / F.col("stride") < picks)).withColumn("pick", at / F.col("stride"))
    few = history.groupBy("user_id").agg(F.count("*").alias("n")).where("n <= 2").select("user_id")
    rows = category_weights(history).join(few, "user_id", "left_semi").join(chosen, "category")
    value = 0.60 * F.col("cw") + 0.25 * quality() + 0.15 * (1 - F.col("pick") / picks)
    scored = rows.withColumn("score", F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 4))
    return top(unseen(scored.select("user_id", "item_id", "score", "popularity", "average_rating"), history), ["user_id"], [F.desc("score"), *popularity_order()], budget).select("user_id", "item_id", "score", "rank")


def category_fill(history: DataFrame, items: DataFrame, taken: DataFrame, target: int = 60, per_category: int = 200) -> DataFrame:
    """Popular items of preferred categories in their order, as many as bring a user's ``taken(user_id, n)`` candidates to ``target``."""
    ranked = top(items, ["category"], popularity_order(), per_category, "place").select("category", "item_id", "place", quality_popularity().alias("score"))
    rows = unseen(preferred_categories(history).select("user_id", "category", F.col("rank").alias("r")).join(ranked, "category"), history)
    placed = top(rows, ["user_id"], [F.col("r"), F.col("place")], target)
    return placed.join(taken, "user_id", "left").where(F.col("rank") <= target - F.coalesce("n", F.lit(0))).select("user_id", "item_id", "score", "rank")


def with_fill(sources: dict[str, DataFrame], history: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """``sources`` and the category fill for users whose other sources, the global list aside, leave room."""
    rows = None
    for name, frame in sources.items():
        if name != "global_popular":
            part = frame.select("user_id", "item_id")
            rows = part if rows is None else rows.unionByName(part)
    return sources | {"category_popular": category_fill(history, items, rows.distinct().groupBy("user_id").agg(F.count("*").alias("n")))}


# Sources that only explore, and those of the floors of sparse and of all profiles.
EXPLORATION = ("aspect_profile", "sparse_category_tail")
SPARSE_FLOOR = ("category_affinity_popular", "category_popular", "sparse_category_tail")
LEXICAL_FLOOR = ("review_term_profile", "lexical_item_neighbor", "bm25_profile")


def mix(merged: DataFrame, items: DataFrame, history: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` candidates of each user in stages: floors of single and grouped sources, protected candidates up to a limit that leaves
    room for exploration, exploring candidates, the rest. Within a stage by priority, popularity, rating and id."""
    sparse = F.coalesce("n_history", F.lit(0)) <= 2
    sizes = history.groupBy("user_id").agg(F.count("*").alias("n_history"))
    rows = merged.join(items.select("item_id", "popularity", "average_rating"), "item_id").join(sizes, "user_id", "left")
    by_priority = [F.desc("priority"), F.desc("popularity"), F.desc(F.coalesce("average_rating", F.lit(0.0))), "item_id"]
    source = F.map_keys("scores")

    def among(condition: Column, order: list) -> Column:
        return F.when(condition, F.row_number().over(Window.partitionBy("user_id", condition).orderBy(*order)))

    def of(*names: str) -> Column:
        return F.arrays_overlap(source, F.array(*map(F.lit, names)))

    def floor(name: str) -> Column:
        return among(of(name), [F.desc(F.element_at("scores", name)), *popularity_order()])

    share = (lambda part: max(1, int(limit * part))) if limit >= 100 else (lambda part: 0)
    popular = F.when(sparse, max(30, int(limit * 0.10))).otherwise(max(20, int(limit * 0.06))) if limit >= 100 else F.lit(max(1, int(limit * 0.10)))
    # stage of each floor for sparse and for other profiles, its candidates' places, its size
    floors = [
        (1, 4, among(of("global_popular"), popularity_order()), popular),
        (2, None, among(of(*SPARSE_FLOOR), by_priority), F.lit(share(0.12))),
        (3, 3, among(of(*LEXICAL_FLOOR), by_priority), F.when(sparse, share(0.12)).otherwise(share(0.07))),
        (4, 2, floor("implicit_item_item"), F.lit(share(0.08))),
        (5, 1, floor("user_neighbor"), F.lit(share(0.05))),
    ]
    stages = [F.when((place <= size) & (F.lit(True) if other is not None else sparse), F.struct(F.when(sparse, first).otherwise(other).cast("int").alias("stage"), place.alias("place"))) for first, other, place, size in floors]
    rows = rows.withColumn("floor", F.array_min(F.array_compact(F.array(*stages))))
    exploring = max(10, int(limit * 0.08)) if limit >= 50 else max(1, int(limit * 0.10))
    free = F.col("floor").isNull()
    protected = F.size(F.array_except(source, F.array(*map(F.lit, EXPLORATION)))) > 0
    in_floors = F.count("floor").over(Window.partitionBy("user_id"))
    rows = rows.withColumns({"in_floors": in_floors, "free": among(free & protected, by_priority), "other": among(free & ~protected, by_priority)})
    late = F.when(F.col("in_floors") + F.col("free") <= limit - exploring, F.struct(F.lit(6).alias("stage"), F.col("free").alias("place"))).when(F.col("other").isNotNull(), F.struct(F.lit(7).alias("stage"), F.col("other").alias("place"))).otherwise(F.struct(F.lit(8).alias("stage"), F.col("free").alias("place")))
    return top(rows.withColumn("at", F.coalesce("floor", late)), ["user_id"], [F.col("at.stage"), F.col("at.place")], limit).select(*merged.columns, F.col("at.stage").alias("stage"), "rank")


def category_popular(history: DataFrame, items: DataFrame, per_category: int = 400, limit: int = 30) -> DataFrame:
    """Popular items of preferred categories: 0.50 category weight + 0.35 log popularity (of the most popular of them) + 0.15 quality."""
    ranked = top(items.withColumn("q", F.coalesce(F.nullif("average_rating", F.lit(0.0)), F.lit(3.5)) / 5), ["category"], popularity_order(), per_category)
    wanted = category_weights(history).drop("r")
    peaks = ranked.groupBy("category").agg(F.max("popularity").alias("peak"))
    most = wanted.join(peaks, "category").groupBy("user_id").agg(F.max("peak").alias("most"))
    rows = wanted.join(most, "user_id").join(ranked.select("category", "item_id", "popularity", "q"), "category")
    value = 0.50 * F.col("cw") + 0.35 * _log_share(F.col("popularity"), F.col("most")) + 0.15 * F.col("q")
    scored = rows.select("user_id", "item_id", F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)), 4).alias("score"))
    return top(unseen(scored, history), ["user_id"], [F.desc("score"), "item_id"], limit)


def global_popular(history: DataFrame, items: DataFrame, limit: int = 35) -> DataFrame:
    """The most popular unseen items of each user; score max(1 - i/limit, 0.70 rating/5 + 0.30, or rating/5 where never rated).

    With the ranks s_1 < s_2 < ... of a user's seen items, the limit-th unseen item has rank limit + #(s_i - i < limit), so
    each user is joined with that many leading ranks only, never with the catalogue.
    """
    ranked = stats.ranked_globally(items.select("item_id", "popularity", "average_rating", quality_popularity().alias("q")), popularity_order(), "place")
    seen = history.select("user_id", "item_id").distinct().join(ranked.select("item_id", "place"), "item_id")
    ahead = F.col("place") - F.row_number().over(Window.partitionBy("user_id").orderBy("place")) < limit
    skipped = seen.withColumn("ahead", ahead).groupBy("user_id").agg(F.sum(F.col("ahead").cast("long")).alias("n"))
    users = history.select("user_id").distinct().join(skipped, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), limit + F.coalesce("n", F.lit(0)))).alias("place"))
    ahead_most = limit + (skipped.agg(F.max("n")).first()[0] or 0)
    leading = ranked.where(F.col("place") <= ahead_most)
    # a few dozen rows where no user has seen most popular items; no broadcast beyond a hundred thousand
    rows = unseen(users.join(F.broadcast(leading) if ahead_most <= 100_000 else leading, "place"), history)
    kept = top(rows, ["user_id"], [F.col("place")], limit)
    return kept.select("user_id", "item_id", F.round(F.greatest(1 - (F.col("rank") - 1) / limit, "q"), 4).alias("score"), "rank")


def merge(sources: dict[str, DataFrame]) -> DataFrame:
    """(user_id, item_id, scores, n_sources, priority): one row per candidate of any source.

    priority = max over sources of (source priority + 0.12 * family confidence * clipped score) + 0.025 * min(sources, 4).
    """
    rows = None
    for name, frame in sources.items():
        family, priority = SOURCES.get(name, ("other", 0.50))
        part = frame.select("user_id", "item_id", F.lit(name).alias("source"), "score", (priority + 0.12 * FAMILY_CONFIDENCE[family] * F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0))).alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    one = rows.groupBy("user_id", "item_id", "source").agg(F.max("score").alias("score"), F.max("p").alias("p"))
    return one.groupBy("user_id", "item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("scores"), F.count("*").alias("n_sources"), F.round(F.max("p") + 0.025 * F.least(F.count("*"), F.lit(4)), 6).alias("priority"))


def pool(merged: DataFrame, items: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` best candidates per user by priority, popularity, rating and id."""
    known = merged.join(items.select("item_id", "popularity", F.coalesce("average_rating", F.lit(0.0)).alias("quality")), "item_id")
    return top(known, ["user_id"], [F.desc("priority"), F.desc("popularity"), F.desc("quality"), "item_id"], limit).drop("popularity", "quality")


