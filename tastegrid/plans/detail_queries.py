"""Queries of smaller operators: text rules, policies, heuristic ratings, filled rankings, file round trips; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tastegrid.functions import text as T
from tastegrid.operators import indexes, profiles, ranking, retrieval, stats, texts
from tastegrid.plans.engine_queries import _history, _vectors, inter, items, table, test, train
from tastegrid.plans.engine_sql import _R01, _UNSEEN, BASE, SQL as ENGINE, _top_terms
from tastegrid.plans.scratch import cut, scratch_path
from tastegrid.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TOKEN = "[a-zA-Z][a-zA-Z0-9_-]{2,}"


def query(sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _once(x: str) -> str:
    """SQL: first occurrences of a list's entries, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_USER_LISTS = f"""{_top_terms("hist")},
    lt AS (SELECT user_id, coalesce(list(term ORDER BY rank) FILTER (mood = 'liked'), []) AS lk, coalesce(list(term ORDER BY rank) FILTER (mood = 'disliked'), []) AS dk FROM tt GROUP BY 1),
    it AS (SELECT item_id, category, average_rating, ({_once(f"regexp_extract_all(lower(vtxt), '{_TOKEN}')")})[1:32] AS its FROM catalogue)
"""


def _lists(history: DataFrame) -> DataFrame:
    """(user_id, liked, disliked): the leading terms of liked and disliked reviews in order."""
    terms = profiles.top_terms(history).groupBy("user_id").pivot("mood", ["liked", "disliked"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]))
    none = F.array().cast("array<string>")
    return terms.select("user_id", F.coalesce("liked", none).alias("liked"), F.coalesce("disliked", none).alias("disliked"))


@query(f"""{BASE}{_USER_LISTS} SELECT t.review_id, array_to_string((list_filter({_once("lk")}, lambda v: list_contains(its, v)))[1:5], ',') AS matched
        FROM test t JOIN lt USING (user_id) JOIN it USING (item_id)""")  # fmt: skip
def f13_matched_terms(spark, sf_dir):
    """a user's liked terms that the target item has."""
    _, history = _history(spark, sf_dir)
    things = profiles.item_profiles(items(spark, sf_dir)).select("item_id", "terms")
    rows = test(spark, sf_dir).select("review_id", "user_id", "item_id").join(_lists(history), "user_id").join(things, "item_id")
    return rows.select("review_id", F.array_join(texts.matched_terms(F.col("liked"), F.col("terms")), ",").alias("matched"))


@query(f"{BASE}{_USER_LISTS} SELECT user_id, array_to_string(({_once('lk || dk')})[1:8], ',') AS merged FROM lt")
def u03_merged_terms(spark, sf_dir):
    """Liked and then disliked terms of a user as one list of at most eight."""
    _, history = _history(spark, sf_dir)
    return _lists(history).select("user_id", F.array_join(texts.merged_terms(F.col("liked"), F.col("disliked")), ",").alias("merged"))


@query(f"""{BASE}, a AS (SELECT round_even(rating, 0)::INT AS stars, regexp_matches(lower(review), '{"|".join(texts.POSITIVE)}') AS p, regexp_matches(lower(review), '{"|".join(texts.NEGATIVE)}') AS m FROM inter)
        SELECT stars, count(*) AS n, count(*) FILTER (CASE WHEN stars >= 4 THEN p OR NOT m WHEN stars <= 2 THEN m OR NOT p ELSE true END) AS n_aligned FROM a GROUP BY 1""")  # fmt: skip
def f22_sentiment(spark, sf_dir):
    """reviews per star and those whose tone fits it."""
    stars = F.bround("rating", 0).cast("int")
    return inter(spark, sf_dir).select(stars.alias("stars"), texts.sentiment_aligned(stars, F.col("review")).alias("fits")).groupBy("stars").agg(F.count("*").alias("n"), F.sum(F.col("fits").cast("long")).alias("n_aligned"))


@query(rf"{BASE} SELECT item_id, trim(regexp_extract(concat('Item: ', name, chr(10), 'Context:  ', category, ' ', chr(10), summary), '(?m)^Context:\s*(.+)$', 1)) AS context FROM catalogue")
def f25_line_values(spark, sf_dir):
    """the value of a labelled line."""
    text = F.concat(F.lit("Item: "), "name", F.lit("\nContext:  "), "category", F.lit(" \n"), "summary")
    return items(spark, sf_dir).select("item_id", texts.line_value(text, "Context").alias("context"))


@query(rf"""{BASE}, k AS (SELECT item_id, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_ -]', '', 'g'), '\s+', '_', 'g') AS t, regexp_replace(trim(summary), '\s+', ' ', 'g')[1:160] AS phrase FROM catalogue)
        SELECT item_id, CASE WHEN length(t) BETWEEN 3 AND 32 THEN t ELSE '' END AS token, phrase FROM k""")  # fmt: skip
def f26_clean_values(spark, sf_dir):
    """names as tokens and summaries as phrases."""
    return items(spark, sf_dir).select("item_id", texts.clean_token(F.col("name")).alias("token"), texts.clean_phrase(F.col("summary")).alias("phrase"))


@query(f"{BASE} SELECT review_id, (list_sum(list_transform(string_split(item_id, ''), lambda c: unicode(c)))::BIGINT + floor(rating)::BIGINT) % 3 AS variant FROM inter")
def f30_variants(spark, sf_dir):
    """wording variant of each review from its item and stars."""
    return inter(spark, sf_dir).select("review_id", texts.variant(F.col("item_id"), F.floor("rating")).alias("variant"))


@query("""SELECT k AS key, count(*) AS n, count(x) AS n_numbers, round(avg(x), 6) AS mean FROM
        (SELECT e.key AS k, TRY_CAST(trim(e.value) AS DOUBLE) AS x FROM (SELECT unnest(map_entries(metadata)) AS e FROM items WHERE metadata IS NOT NULL)) GROUP BY 1""")  # fmt: skip
def f28_numeric_values(spark, sf_dir):
    """metadata values that are numbers, per key."""
    rows = table(spark, sf_dir, "items").select(F.explode("metadata").alias("key", "value")).withColumn("x", F.trim("value").try_cast("double"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count("x").alias("n_numbers"), F.round(F.avg("x"), 6).alias("mean"))


@query(f"{BASE} SELECT review_id, concat_ws(':', user_id, item_id, ts::VARCHAR, (row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, review_id))::VARCHAR) AS stable_id FROM inter")
def p02_stable_ids(spark, sf_dir):
    """Ids made of user, item, time and place."""
    place = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy("ts", "review_id"))
    return inter(spark, sf_dir).select("review_id", files.stable_review_id(F.col("user_id"), F.col("item_id"), F.col("ts"), place).alias("stable_id"))


@query(f"""{BASE}, wl AS (SELECT *, greatest(least(rating / 5, 1.0), 0.15) AS w FROM liked), tot AS (SELECT item_id, sum(w) AS w FROM wl GROUP BY 1),
        capped AS (SELECT * FROM wl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) <= 50),
        co AS (SELECT l.item_id, r.item_id AS neighbor_id, sum(sqrt(l.w) * sqrt(r.w)) AS n FROM capped l JOIN capped r ON l.user_id = r.user_id AND l.item_id <> r.item_id GROUP BY 1, 2),
        sc AS (SELECT co.item_id, neighbor_id, round(n / sqrt(a.w * b.w), 4) AS score FROM co JOIN tot a ON a.item_id = co.item_id JOIN tot b ON b.item_id = neighbor_id)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_id) AS rank FROM sc QUALIFY rank <= 20""")  # fmt: skip
def j05_weighted_covisitation(spark, sf_dir):
    """Co-visitation with interactions weighted by their rating."""
    return indexes.covisitation(train(spark, sf_dir), weighted=True)


@query(f"{BASE} SELECT review_id, user_id, item_id FROM test WHERE rating >= 4")
def p06_positive_targets(spark, sf_dir):
    """Test targets that were liked."""
    return test(spark, sf_dir).where("rating >= 4").select("review_id", "user_id", "item_id")


@query(f"{BASE} SELECT item_id, count(*) AS n, array_to_string(list_sort(list(rating::VARCHAR)), ',') AS ratings, round(avg(rating), 6) AS mean FROM test GROUP BY 1")
def a41_item_ratings(spark, sf_dir):
    """Ratings of the test targets per item, with their mean."""
    r = F.col("rating").cast("string")
    return test(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(r)), ",").alias("ratings"), F.round(F.avg("rating"), 6).alias("mean"))


@query(f"""{BASE}{_R01}, own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS k FROM norm n {_UNSEEN}),
        c AS (SELECT item_id, count(*) AS c FROM train WHERE rating >= 4 GROUP BY 1),
        pp AS (SELECT item_id, row_number() OVER (ORDER BY coalesce(c, 0) DESC, item_id DESC) AS k FROM catalogue LEFT JOIN c USING (item_id) QUALIFY k <= 20),
        u AS (SELECT user_id, item_id, min(z) AS z FROM (SELECT user_id, item_id, k AS z FROM own WHERE k <= 10 UNION ALL SELECT u.user_id, pp.item_id, 1000 + pp.k FROM (SELECT DISTINCT user_id FROM hist) u, pp) GROUP BY 1, 2)
        SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY z) AS rank FROM u QUALIFY rank <= 10""")  # fmt: skip
def w15_filled_rankings(spark, sf_dir):
    """Each user's ten co-visitation candidates, filled up with the most popular items."""
    t, history = _history(spark, sf_dir)
    own = retrieval.co_visitation(history, indexes.covisitation(t)).drop("rank")
    own = indexes.top(own, ["user_id"], [F.desc("score"), "item_id"], 10, "z").select("user_id", "item_id", F.col("z").cast("long").alias("z"))
    # twenty items, whatever the catalogue
    popular = stats.popularity(t, items(spark, sf_dir), True).where("rank <= 20").agg(F.collect_list(F.struct("item_id", (F.col("rank") + 1000).cast("long").alias("z"))).alias("xs"))
    fill = history.select("user_id", F.lit(1).alias("one")).distinct().join(F.broadcast(popular.withColumn("one", F.lit(1))), "one").select("user_id", F.explode("xs").alias("x")).select("user_id", "x.item_id", "x.z")
    both = own.unionByName(fill).groupBy("user_id", "item_id").agg(F.min("z").alias("z"))
    return indexes.top(both, ["user_id"], [F.col("z")], 10).select("user_id", "item_id", "rank")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def t13_recent_events(spark, sf_dir):
    """The hundred latest events."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


def _hashed(source: str, key: str, name: str) -> str:
    return f""",
    {name}1 AS (SELECT {key}, term, count(*) AS n, sha256(term) AS h FROM ({source}) GROUP BY 1, 2),
    {name}2 AS (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(n))) AS v FROM {name}1 GROUP BY 1, 2),
    {name} AS (SELECT {key}, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 6) AS v FROM {name}2 QUALIFY sum(v * v) OVER (PARTITION BY {key}) > 0)"""


@query(f"""{BASE}{_USER_LISTS},
        ur AS (SELECT user_id, round(avg(rating), 2) AS m FROM hist GROUP BY 1),
        af AS (SELECT user_id, category, round((avg(rating) - 3) / 2, 3) AS a FROM hist GROUP BY 1, 2)
        {_hashed(f"SELECT user_id, unnest(regexp_extract_all(lower(concat_ws(' ', name, category, review)), '{_TOKEN}')) AS term FROM hist WHERE rating >= 4", "user_id", "hu")}
        {_hashed(f"SELECT item_id, unnest(regexp_extract_all(lower(vtxt), '{_TOKEN}')) AS term FROM catalogue", "item_id", "hi")},
        pc AS (SELECT user_id, category, count(*) FILTER (rating >= 4) AS l, count(*) AS a, min(struct_pack(ts := ts, review_id := review_id)) AS f FROM hist GROUP BY 1, 2),
        pc2 AS (SELECT *, CASE WHEN max(l) OVER (PARTITION BY user_id) > 0 THEN l ELSE a END AS n FROM pc),
        pf AS (SELECT user_id, category FROM pc2 WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, category) <= 5),
        vm AS (SELECT t.review_id, greatest(coalesce(sum(hu.v * hi.v), 0), 0) AS v FROM test t LEFT JOIN hu USING (user_id) LEFT JOIN hi ON hi.item_id = t.item_id AND hi.slot = hu.slot GROUP BY 1),
        ov AS (SELECT t.*, it.average_rating, it.category AS ic, ur.m, vm.v, coalesce(af.a, 0) AS a, pf.user_id IS NOT NULL AS pref,
                      CASE WHEN len(lk) > 0 AND len(its) > 0 THEN len(list_filter(lk, lambda x: list_contains(its, x))) / len(lk) ELSE 0 END AS pm,
                      CASE WHEN len(dk) > 0 AND len(its) > 0 THEN len(list_filter(dk, lambda x: list_contains(its, x))) / len(dk) ELSE 0 END AS dm
               FROM test t JOIN it USING (item_id) JOIN ur ON ur.user_id = t.user_id LEFT JOIN lt ON lt.user_id = t.user_id JOIN vm ON vm.review_id = t.review_id
               LEFT JOIN af ON af.user_id = t.user_id AND af.category = it.category LEFT JOIN pf ON pf.user_id = t.user_id AND pf.category = it.category)
        SELECT review_id, round_even(round(least(greatest(m + coalesce((average_rating - 3.5) * 0.25, 0) + 0.45 * least(coalesce(pm, 0), 0.75) + 0.15 * v + CASE WHEN pref THEN 0.25 ELSE 0 END + 0.50 * greatest(a, 0) - 0.65 * least(coalesce(dm, 0), 0.75), 1), 5), 6), 0)::INT AS stars FROM ov""")  # fmt: skip
def m05_profile_heuristic(spark, sf_dir):
    """Stars of each test row from the user's profile and the item's text."""
    _, history = _history(spark, sf_dir)
    history, catalogue = cut(history), items(spark, sf_dir)
    said = history.where("rating >= 4").select("user_id", F.explode(T.terms(T.join_parts(F.col("name"), F.col("category"), F.col("review")))).alias("term"))
    about = catalogue.select("item_id", F.explode(T.terms(indexes.item_text(False))).alias("term"))
    means = history.groupBy("user_id").agg(F.round(F.avg("rating"), 2).alias("mean"))
    liked = retrieval.preferred_categories(history).select("user_id", "category", F.lit(True).alias("preferred"))
    things = profiles.item_profiles(catalogue).select("item_id", "category", "terms").join(catalogue.select("item_id", "average_rating"), "item_id").join(_vectors(about, "item_id").withColumnRenamed("vector", "item_vector"), "item_id", "left")
    people = means.join(_lists(history), "user_id", "left").join(_vectors(said, "user_id").withColumnRenamed("vector", "user_vector"), "user_id", "left")
    rows = test(spark, sf_dir).select("review_id", "user_id", "item_id").join(things, "item_id").join(people, "user_id").join(profiles.category_affinity(history), ["user_id", "category"], "left").join(liked, ["user_id", "category"], "left")
    none = F.array().cast("array<string>")

    def share(column: str):
        return F.least(T.overlap(F.coalesce(column, none), F.coalesce("terms", none)), F.lit(0.75))

    near = F.greatest(F.coalesce(T.dot(F.col("user_vector"), F.col("item_vector")), F.lit(0.0)), F.lit(0.0))
    raw = F.col("mean") + F.coalesce((F.col("average_rating") - 3.5) * 0.25, F.lit(0.0)) + 0.45 * share("liked") + 0.15 * near + F.when(F.col("preferred"), 0.25).otherwise(0.0) + 0.50 * F.greatest(F.coalesce("affinity", F.lit(0.0)), F.lit(0.0)) - 0.65 * share("disliked")
    return rows.select("review_id", F.bround(F.round(F.greatest(F.least(raw, F.lit(5.0)), F.lit(1.0)), 6), 0).cast("int").alias("stars"))


@query(f"""{BASE}, n AS (SELECT user_id, count(*) <= 2 AS few FROM hist GROUP BY 1)
        SELECT user_id, CASE WHEN few THEN 'balanced+cold_start' ELSE 'balanced' END AS policy, CASE WHEN few THEN 0.30 ELSE 0.24 END::DOUBLE AS preference_match, CASE WHEN few THEN 0.26 ELSE 0.18 END::DOUBLE AS category_match,
               CASE WHEN few THEN 0.24 ELSE 0.18 END::DOUBLE AS vector_match, CASE WHEN few THEN 0.22 ELSE 0.16 END::DOUBLE AS aspect_match, CASE WHEN few THEN 0.12 ELSE 0.18 END::DOUBLE AS popularity,
               CASE WHEN few THEN 0.10 ELSE 0.04 END::DOUBLE AS retrieval_match, CASE WHEN few THEN 0.08 ELSE 0.0 END::DOUBLE AS source_diversity,
               CASE WHEN few THEN 0.22 ELSE 0.02 END::DOUBLE AS personal_floor, CASE WHEN few THEN 0.72 ELSE 0.65 END::DOUBLE AS personal_ceiling FROM n""")  # fmt: skip
def g05_adaptive_policy(spark, sf_dir):
    """Ranking weights of every test user by the size of the history, without context."""
    _, history = _history(spark, sf_dir)
    return ranking.adaptive_policy(history.groupBy("user_id").agg(F.count("*").alias("evidence_count")))


@query(f"{ENGINE['s04_items']}")
def k01_items_as_json_lines(spark, sf_dir):
    """The catalogue written as compressed JSON lines and read again with its schema."""
    rows = items(spark, sf_dir).select("item_id", "name", "category", "summary", "average_rating", "popularity")
    files.write_jsonl(rows, path := scratch_path(spark, "jsonl"), "gzip")
    return files.read_jsonl(spark, path, rows.schema)


@query(f"{BASE} SELECT item_id, name, coalesce(category, '') AS category FROM catalogue")
def s19_items_as_csv(spark, sf_dir):
    """Names and categories written as CSV and read again by the reader that detects encodings."""
    rows = items(spark, sf_dir).select("item_id", "name", "category")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path := scratch_path(spark, "csv"))
    return files.read_csv_any_encoding(spark, path)


@query(f"{ENGINE['j05_covisitation']}")
def k03_stored_neighbors(spark, sf_dir):
    """Neighbours stored bucketed by item and read again."""
    name = "neighbors_" + scratch_path(spark, "n")[-32:]
    rows = indexes.covisitation(train(spark, sf_dir))
    files.write_neighbors(rows, name, path=scratch_path(spark, "neighbors"))
    return spark.table(name).select(*rows.columns)


@query(f"""{BASE} SELECT user_id, item_id, name AS item_name, rating, trim(review) AS review, category, ts AS timestamp FROM inter WHERE ts < 100000000000""")
def s05_feed(spark, sf_dir):
    """Interactions written in the older column names of a raw feed and scanned again with its column variants."""
    rows = inter(spark, sf_dir)
    raw = rows.select(F.col("user_id").alias("reviewerID"), F.col("item_id").alias("asin"), F.col("name").alias("title"), F.col("rating").alias("overall"), F.col("review").alias("reviewText"), "category", F.col("ts").alias("unixReviewTime"))
    files.write_jsonl(raw, path := scratch_path(spark, "feed"))
    return files.read_feed(spark, path, "amazon")


@query(f"{BASE} SELECT item_id, coalesce(category, '') AS category FROM catalogue UNION ALL SELECT DISTINCT item_id, 'unlisted' FROM item_terms WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM catalogue)")
def u01_combined(spark, sf_dir):
    """The catalogue, and items that only the stored terms know; the first table with an item wins."""
    others = table(spark, sf_dir, "item_terms").where("item_id is not null").select("item_id").distinct().withColumn("category", F.lit("unlisted"))
    return files.combine([items(spark, sf_dir).select("item_id", "category"), others], "item_id")
