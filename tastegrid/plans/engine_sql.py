"""DuckDB SQL of the engine queries, written independently of the operators."""

from __future__ import annotations

from tastegrid.functions.words import ASPECT_STOPWORDS, ASPECTS, PROFILE_STOPWORDS, REVIEW_STOPWORDS


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CATEGORY = r"coalesce(nullif(regexp_replace(lower(trim(category)), '[\s-]+', '_', 'g'), ''), 'unknown')"

BASE = f"""
    WITH inter AS (
        SELECT review_id, any_value(user_id) AS user_id, any_value(item_id) AS item_id, any_value(coalesce(nullif(item_name, ''), item_id)) AS name,
               any_value(rating) AS rating, any_value(review) AS review, any_value({_CATEGORY}) AS category,
               any_value(CASE WHEN timestamp >= 100000000000 THEN timestamp // 1000 ELSE coalesce(timestamp, 0) END) AS ts
        FROM reviews WHERE user_id <> '' AND item_id <> '' AND trim(review) <> '' AND rating >= 1 AND rating <= 5 GROUP BY review_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) = 1 AND count(*) OVER (PARTITION BY user_id) > 1 AS is_test FROM inter),
    train AS (SELECT * FROM placed WHERE NOT is_test),
    test AS (SELECT * FROM placed WHERE is_test),
    cat AS (
        SELECT item_id, any_value(coalesce(name, item_id)) AS name, any_value({_CATEGORY}) AS category, any_value(metadata) AS metadata,
               any_value(coalesce(summary, '')) AS summary, any_value(CASE WHEN isnan(average_rating) THEN NULL ELSE average_rating END) AS average_rating
        FROM items WHERE item_id <> '' GROUP BY item_id),
    catalogue AS (
        SELECT *, coalesce(nullif(TRY_CAST(metadata['rating_number'] AS BIGINT), 0), TRY_CAST(metadata['review_count'] AS BIGINT), 0) AS popularity,
               concat_ws(' ', name, category, summary, array_to_string(list_transform(map_entries(metadata), lambda e: concat_ws(' ', e.key, e.value)), ' ')) AS txt,
               concat_ws(' ', name, category, summary, array_to_string(map_values(metadata), ' ')) AS vtxt
        FROM cat),
    hist AS (SELECT * FROM train WHERE user_id IN (SELECT user_id FROM test)),
    liked AS (SELECT user_id, item_id, unnest(max(struct_pack(ts := ts, review_id := review_id, rating := rating, category := category))) FROM train WHERE rating >= 4 GROUP BY user_id, item_id)
"""

_COVIS = """,
    tot AS (SELECT item_id, count(*) AS w FROM liked GROUP BY 1),
    capped AS (SELECT * FROM liked QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) <= 50),
    co AS (SELECT l.item_id, r.item_id AS neighbor_id, count(*) AS n FROM capped l JOIN capped r ON l.user_id = r.user_id AND l.item_id <> r.item_id GROUP BY 1, 2),
    sc AS (SELECT co.item_id, neighbor_id, round(n / sqrt(a.w * b.w), 4) AS score FROM co JOIN tot a ON a.item_id = co.item_id JOIN tot b ON b.item_id = neighbor_id),
    neigh AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_id) AS rank FROM sc QUALIFY rank <= 20)
"""


def _normalised(raw: str, limit: int, seen: bool) -> str:
    """CTE ``norm`` from a table of (user_id, item_id, raw); ``seen`` keeps items of the history."""
    anti = "" if seen else "WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = x.user_id AND h.item_id = x.item_id)"
    return f""",
    rnd AS (SELECT user_id, item_id, round(raw, 9) AS raw FROM {raw} x {anti}),
    kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, item_id) AS rank FROM rnd QUALIFY rank <= {limit}),
    norm AS (SELECT user_id, item_id, round(least(raw / max(raw) OVER (PARTITION BY user_id), 1.0), 4) AS score, rank FROM kept)
"""


_UNSEEN = "WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = n.user_id AND h.item_id = n.item_id)"

_R01 = (
    _COVIS
    + """,
    votes AS (SELECT h.user_id, g.neighbor_id AS item_id, sum(greatest((h.rating - 3) / 2, 0.1) * g.score) AS raw FROM hist h JOIN neigh g USING (item_id) WHERE h.rating >= 4 GROUP BY 1, 2)
"""
    + _normalised("votes", 35, True)
)

_USER_ITEMS = """,
    ui AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, ts DESC, item_id DESC) AS rank FROM liked QUALIFY rank <= 50),
    iu AS (SELECT item_id, user_id, rating, ts, row_number() OVER (PARTITION BY item_id ORDER BY rating DESC, ts DESC, user_id DESC) AS rank FROM ui QUALIFY rank <= 500)
"""

_R02 = (
    _USER_ITEMS
    + """,
    hop AS (SELECT h.user_id, i.user_id AS other, round(sum(greatest((h.rating - 3) / 2, 0.1)), 9) AS s FROM hist h JOIN iu i ON i.item_id = h.item_id WHERE h.rating >= 4 GROUP BY 1, 2),
    nearest AS (SELECT * FROM hop QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, other) <= 200),
    reach AS (SELECT n.user_id, u.item_id, sum(n.s) AS raw FROM nearest n JOIN ui u ON u.user_id = n.other GROUP BY 1, 2)
"""
    + _normalised("reach", 35, False)
)

_COSINE = """,
    cells AS (SELECT user_id, item_id, sum(greatest(rating, 0.1)) AS v FROM train WHERE item_id IN (SELECT item_id FROM catalogue) GROUP BY 1, 2),
    norms AS (SELECT item_id, sqrt(sum(v * v)) AS nv FROM cells GROUP BY 1),
    dots AS (SELECT l.item_id, r.item_id AS neighbor_id, sum(l.v * r.v) AS d FROM cells l JOIN cells r ON l.user_id = r.user_id AND l.item_id <> r.item_id GROUP BY 1, 2),
    cs AS (SELECT d.item_id, neighbor_id, round(d.d / (a.nv * b.nv), 6) AS score FROM dots d JOIN norms a ON a.item_id = d.item_id JOIN norms b ON b.item_id = neighbor_id
           WHERE d.item_id IN (SELECT item_id FROM train WHERE rating >= 4))
"""


def _cosine(k: int) -> str:
    return _COSINE + f", cosn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_id) AS rank FROM cs QUALIFY rank <= {k})"


_R03 = (
    _cosine(120)
    + """,
    seeds AS (SELECT user_id, item_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating DESC, item_id DESC, review_id DESC) AS i FROM hist WHERE rating >= 4 QUALIFY i <= 12),
    ivotes AS (SELECT s.user_id, c.neighbor_id AS item_id, sum(greatest((s.rating - 3) / 2, 0.25) / sqrt(s.i) * c.score) AS raw FROM seeds s JOIN cosn c USING (item_id) GROUP BY 1, 2)
"""
    + _normalised("ivotes", 42, False)
)


def _review_terms(text: str) -> str:
    """Unigrams without stop words, then unequal neighbours as bigrams."""
    base = rf"list_filter(regexp_extract_all(regexp_replace(lower({text}), '(\d+)\s*(oz|ml|inch|inches|count|pack)', '\1_\2', 'g'), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), lambda t: NOT list_contains({_list(REVIEW_STOPWORDS)}, t))"
    return base


_TERMS = f""",
    words AS (SELECT item_id, 1.25 AS w, {_review_terms("txt")} AS b FROM catalogue
              UNION ALL SELECT item_id, 2.0, {_review_terms("concat_ws(' ', name, category, review)")} FROM train WHERE rating >= 4),
    tok AS (SELECT item_id, w, unnest(b) AS term FROM words
            UNION ALL SELECT item_id, w, unnest(list_filter(list_transform(range(1, len(b)), lambda k: CASE WHEN b[k] <> b[k + 1] THEN b[k] || '_' || b[k + 1] END), lambda x: x IS NOT NULL)) FROM words),
    tf AS (SELECT item_id, term, sum(w) AS tf FROM tok GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    nn AS (SELECT count(DISTINCT item_id)::DOUBLE AS n FROM tf),
    tsc AS (SELECT item_id, term, round((1 + ln(tf)) * ln(1 + n / (1 + df)), 4) AS score FROM tf JOIN dfs USING (term), nn),
    best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, term) AS rank FROM tsc QUALIFY rank <= 18),
    posc AS (SELECT item_id, count(*) AS c FROM train WHERE rating >= 4 GROUP BY 1),
    iterms AS (SELECT b.*, round(score * (1 + ln(1 + coalesce(c, 0)) * 0.04), 4) AS posting FROM best b LEFT JOIN posc USING (item_id) WHERE score > 0),
    post AS (SELECT term, item_id, posting, row_number() OVER (PARTITION BY term ORDER BY posting DESC, item_id DESC) AS rank FROM iterms QUALIFY rank <= 250)
"""

_PREFERRED = """,
    pc AS (SELECT user_id, category, count(*) FILTER (rating >= 4) AS l, count(*) AS a, min(struct_pack(ts := ts, review_id := review_id)) AS f FROM {0} GROUP BY 1, 2),
    pc2 AS (SELECT *, CASE WHEN max(l) OVER (PARTITION BY user_id) > 0 THEN l ELSE a END AS n FROM pc),
    pref AS (SELECT user_id, category, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, category) AS rank FROM pc2 WHERE n > 0 QUALIFY rank <= 5)
"""

_R04 = (
    _TERMS
    + _PREFERRED.format("hist")
    + f""",
    hw AS (SELECT user_id, item_id, greatest((rating - 2) / 3, 0.2) AS w, {_review_terms("concat_ws(' ', name, category, review)")} AS b FROM hist WHERE rating >= 3),
    qt AS (SELECT user_id, unnest(b) AS term, w FROM hw
           UNION ALL SELECT user_id, unnest(list_filter(list_transform(range(1, len(b)), lambda k: CASE WHEN b[k] <> b[k + 1] THEN b[k] || '_' || b[k + 1] END), lambda x: x IS NOT NULL)), w FROM hw
           UNION ALL SELECT user_id, term, w * score FROM hw JOIN iterms USING (item_id)),
    qs AS (SELECT user_id, term, round(sum(w), 9) AS w FROM qt GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(sum(w), 9) DESC, term) <= 28),
    rt AS (SELECT q.user_id, p.item_id, sum(q.w * p.posting) AS raw FROM qs q JOIN post p USING (term) GROUP BY 1, 2),
    rtb AS (SELECT rt.user_id, rt.item_id, raw * CASE WHEN pref.category IS NULL THEN 1.0 ELSE 1.16 END AS raw FROM rt LEFT JOIN catalogue c USING (item_id) LEFT JOIN pref ON pref.user_id = rt.user_id AND pref.category = c.category)
"""
    + _normalised("rtb", 38, False)
)

_R06 = (
    _TERMS
    + """,
    lead_ AS (SELECT h.user_id, i.term, sum(greatest((h.rating - 3) / 2, 0.1) * i.score) AS w FROM hist h JOIN iterms i USING (item_id) WHERE h.rating >= 4 AND i.rank <= 12 GROUP BY 1, 2),
    lx AS (SELECT l.user_id, p.item_id, sum(l.w * p.posting) AS raw FROM lead_ l JOIN post p USING (term) GROUP BY 1, 2)
"""
    + _normalised("lx", 30, False)
)

_R24 = (
    _PREFERRED.format("hist")
    + """,
    aff AS (SELECT user_id, category, (avg(rating) - 3) / 2 AS a FROM hist GROUP BY 1, 2),
    rk AS (SELECT *, coalesce(nullif(average_rating, 0), 3.5) / 5 AS q FROM catalogue QUALIFY row_number() OVER (PARTITION BY category ORDER BY popularity DESC, coalesce(average_rating, 0) DESC, item_id DESC) <= 400),
    cw AS (SELECT p.user_id, p.category, greatest(greatest(1 - 0.08 * (p.rank - 1), 0.65), least(0.65 + coalesce(a, 0), 1.0)) AS w FROM pref p LEFT JOIN aff ON aff.user_id = p.user_id AND aff.category = p.category),
    el AS (SELECT cw.user_id, r.item_id, w, r.popularity, r.q, max(r.popularity) OVER (PARTITION BY cw.user_id) AS m FROM cw JOIN rk r ON r.category = cw.category),
    cp AS (SELECT user_id, item_id, round(least(greatest(0.50 * w + 0.35 * CASE WHEN popularity > 0 THEN ln(1 + popularity) / ln(1 + m) ELSE 0 END + 0.15 * q, 0), 1), 4) AS score FROM el),
    r24 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cp n """
    + _UNSEEN
    + """ QUALIFY rank <= 30)
"""
)

_R26 = (
    """,
    gp AS (SELECT u.user_id, c.item_id, c.popularity, c.average_rating, coalesce(nullif(c.average_rating, 0), 3.5) / 5 AS q FROM (SELECT DISTINCT user_id FROM hist) u, catalogue c),
    gr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY popularity DESC, coalesce(average_rating, 0) DESC, item_id DESC) AS rank FROM gp n """
    + _UNSEEN
    + """ QUALIFY rank <= 35)
"""
)


def _aspect_hits(table: str, text: str, keep: str) -> str:
    tokens = f"list_filter(regexp_extract_all(lower({text}), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), lambda t: NOT list_contains({_list(ASPECT_STOPWORDS)}, t))"
    names = ", ".join(f"struct_pack(aspect := '{a}', hits := len(list_intersect(list_distinct(tks), {_list(w)})))" for a, w in ASPECTS.items())
    return f"SELECT {keep}, e.aspect AS aspect, e.hits AS hits FROM (SELECT {keep}, unnest([{names}]) AS e FROM (SELECT *, {tokens} AS tks FROM {table})) WHERE e.hits > 0"


def _scaled(source: str, key: str, value: str) -> str:
    return f"SELECT {key}, aspect, round(greatest(least({value} / max(abs({value})) OVER (PARTITION BY {key}), 1.0), -1.0), 4) AS score FROM {source} QUALIFY max(abs({value})) OVER (PARTITION BY {key}) > 0"


_ITEM_ASPECTS = f""",
    ih AS ({_aspect_hits("catalogue", "txt", "item_id")}),
    ia AS ({_scaled("ih", "item_id", "hits")})
"""
_USER_ASPECTS = """,
    uw AS (SELECT *, (1 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, review_id) - 1) / count(*) OVER (PARTITION BY user_id) * 0.35)
           * CASE WHEN rating >= 4 THEN 1.0 WHEN rating <= 2 THEN -0.85 ELSE 0.35 END AS w FROM {0}),
    uh AS ({1}),
    us AS (SELECT user_id, aspect, sum(w * hits) AS raw FROM uh GROUP BY 1, 2),
    ua AS ({2})
"""
_ASPECT_ITEMS = (
    _ITEM_ASPECTS
    + f""",
    rh AS ({_aspect_hits("(SELECT * FROM train WHERE rating >= 4)", "concat_ws(' ', name, category, review)", "review_id, item_id")}),
    rs AS ({_scaled("rh", "review_id, item_id", "hits")}),
    ev AS (SELECT c.category, ia.aspect, ia.item_id, greatest(ia.score, 0.05) + 0.6 * coalesce(nullif(c.average_rating, 0), 3.5) / 5
                  + 0.4 * CASE WHEN c.popularity > 0 THEN least(ln(1 + c.popularity) / ln(1001), 1.0) ELSE 0 END AS w FROM ia JOIN catalogue c USING (item_id)
           UNION ALL SELECT c.category, rs.aspect, rs.item_id, rs.score FROM rs JOIN catalogue c USING (item_id)),
    ew AS (SELECT aspect, item_id, round(sum(w), 6) AS w FROM ev GROUP BY 1, 2),
    ai AS (SELECT aspect, item_id, round(w / max(w) OVER (PARTITION BY aspect), 4) AS score, row_number() OVER (PARTITION BY aspect ORDER BY w DESC, item_id) AS rank FROM ew QUALIFY rank <= 120),
    ecw AS (SELECT category, aspect, item_id, round(sum(w), 6) AS w FROM ev GROUP BY 1, 2, 3),
    cai AS (SELECT category, aspect, item_id, round(w / max(w) OVER (PARTITION BY category, aspect), 4) AS score, row_number() OVER (PARTITION BY category, aspect ORDER BY w DESC, item_id) AS rank FROM ecw QUALIFY rank <= 120)
"""
)
_TRANSITIONS = """,
    nx AS (SELECT item_id, category, lead(item_id) OVER (PARTITION BY user_id ORDER BY ts, review_id) AS dst FROM train WHERE rating >= 4),
    ed AS (SELECT 'item' AS kind, item_id AS src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL AND dst <> item_id GROUP BY 2, 3
           UNION ALL SELECT 'category', category, dst, count(*) FROM nx WHERE dst IS NOT NULL GROUP BY 2, 3),
    tr AS (SELECT kind, src, dst, round(n / max(n) OVER (PARTITION BY kind, src), 4) AS score, row_number() OVER (PARTITION BY kind, src ORDER BY n DESC, dst) AS rank FROM ed QUALIFY rank <= 120)
"""


def _ua(table: str) -> str:
    return _USER_ASPECTS.format(table, _aspect_hits("uw", "concat_ws(' ', name, category, review)", "user_id, w"), _scaled("us", "user_id", "raw"))


_R08 = (
    _ASPECT_ITEMS
    + _TRANSITIONS
    + _ua("hist")
    + _PREFERRED.format("hist")
    + """,
    l4 AS (SELECT * FROM hist WHERE rating >= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) <= 4),
    act AS (SELECT * FROM ua WHERE score > 0),
    ge AS (SELECT l.user_id, t.dst AS item_id, 'sequential_transition' AS source, 0.92 * t.score AS v FROM l4 l JOIN tr t ON t.kind = 'item' AND t.src = l.item_id
           UNION ALL SELECT l.user_id, t.dst, 'category_transition', 0.58 * t.score FROM l4 l JOIN tr t ON t.kind = 'category' AND t.src = l.category
           UNION ALL SELECT a.user_id, i.item_id, 'aspect_evidence_graph', a.score * i.score FROM act a JOIN ai i USING (aspect)
           UNION ALL SELECT a.user_id, i.item_id, 'category_aspect_graph', 1.18 * a.score * i.score FROM act a JOIN pref p ON p.user_id = a.user_id AND p.rank <= 4 JOIN cai i ON i.aspect = a.aspect AND i.category = p.category),
    gk AS (SELECT user_id, item_id, source, sum(v) AS s, max(v) AS m FROM ge GROUP BY 1, 2, 3),
    gs AS (SELECT user_id, item_id, round(sum(s), 9) AS raw, arg_max(source, struct_pack(m := round(m, 9), source := source)) AS source FROM gk GROUP BY 1, 2),
    gn AS (SELECT user_id, item_id, source, round(least(raw / max(raw) OVER (PARTITION BY user_id), 1.0), 4) AS score FROM gs),
    gr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM gn n """
    + _UNSEEN
    + """ QUALIFY rank <= 72)
"""
)

_BM25 = """,
    bt AS (SELECT item_id, regexp_extract_all(lower(vtxt), '[a-zA-Z][a-zA-Z0-9_-]{2,}') AS ts FROM catalogue),
    bn AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM bt),
    bc AS (SELECT item_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT item_id, len(ts) AS dl, unnest(ts) AS term FROM bt) GROUP BY 1, 2),
    bd AS (SELECT term, count(*) AS df FROM bc GROUP BY 1),
    bi AS (SELECT item_id, term, tf, dl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM bc JOIN bd USING (term), bn)
"""


def _top_terms(table: str) -> str:
    tokens = f"list_filter(regexp_extract_all(lower(concat_ws(' ', review, name, category)), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), lambda t: NOT list_contains({_list(PROFILE_STOPWORDS)}, t))"
    return f""",
    tm AS (SELECT user_id, CASE WHEN rating >= 4 THEN 'liked' ELSE 'disliked' END AS mood, unnest({tokens}) AS term FROM {table} WHERE rating >= 4 OR rating <= 2),
    tt AS (SELECT user_id, mood, term, count(*) AS n, row_number() OVER (PARTITION BY user_id, mood ORDER BY count(*) DESC, term) AS rank FROM tm GROUP BY 1, 2, 3 QUALIFY rank <= 8)
"""


_R13 = _BM25 + _top_terms("hist") + """,
    bq AS (SELECT q.user_id, b.item_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM tt q JOIN bi b USING (term) WHERE q.mood = 'liked' GROUP BY 1, 2)
""" + _normalised("bq", 35, True)  # fmt: skip


def _stats(*keys: str) -> str:
    k = ", ".join(keys)
    return f"""{BASE} SELECT {k + "," if k else ""} count(*) AS n, round(avg(rating), 6) AS mean, round(stddev_pop(rating), 6) AS std,
        round(avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END), 6) AS positive_share, round(avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END), 6) AS negative_share
        FROM train {"GROUP BY " + k if k else ""}"""


def _shrink(mean: str, n: str, prior: str, weight: int) -> str:
    return f"CASE WHEN coalesce({n}, 0) > 0 THEN ({mean} * {n} + {prior} * {weight}) / ({n} + {weight}) ELSE {prior} END"


_FEATURES = f""",
    g AS (SELECT avg(rating) AS m FROM train),
    su AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1),
    si AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1),
    sk AS (SELECT category, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1),
    sx AS (SELECT user_id, category, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1, 2),
    sr AS (SELECT user_id, avg(rating) AS m FROM (SELECT * FROM train QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, review_id DESC) <= 3) GROUP BY 1),
    f0 AS (SELECT t.review_id, t.category, t.rating, g.m AS gm, coalesce(su.n, 0) AS user_n, coalesce(si.n, 0) AS item_n, coalesce(sk.n, 0) AS cat_n, coalesce(sx.n, 0) AS uc_n,
                  coalesce(su.m, g.m) AS um, coalesce(si.m, g.m) AS im, coalesce(sk.m, g.m) AS cm, coalesce(sx.m, su.m, g.m) AS ucm, coalesce(sr.m, su.m, g.m) AS rm
           FROM test t LEFT JOIN su USING (user_id) LEFT JOIN si USING (item_id) LEFT JOIN sk USING (category)
           LEFT JOIN sx ON sx.user_id = t.user_id AND sx.category = t.category LEFT JOIN sr ON sr.user_id = t.user_id, g),
    feat AS (SELECT *, {_shrink("um", "user_n", "gm", 4)} AS user_prior, {_shrink("rm", "least(user_n, 3)", "gm", 3)} AS user_recent_prior, {_shrink("im", "item_n", "gm", 8)} AS item_prior,
                  {_shrink("cm", "cat_n", "gm", 100)} AS category_prior, {_shrink("ucm", "uc_n", "cm", 4)} AS user_category_prior,
                  least(greatest(gm + user_n / (user_n + 4) * (um - gm) + item_n / (item_n + 8) * (im - gm) + cat_n / (cat_n + 100) * (cm - gm) + uc_n / (uc_n + 4) * (ucm - cm), 1), 5) AS bias_prior FROM f0),
    heads AS (SELECT rating, user_n, category, unnest([
                  struct_pack(head := 'head_global', p := gm), struct_pack(head := 'head_user', p := um), struct_pack(head := 'head_item', p := im),
                  struct_pack(head := 'head_user_item_bias', p := least(greatest(um + im - gm, 1), 5)),
                  struct_pack(head := 'head_calibrated', p := least(greatest((0.42 * user_prior + 0.38 * item_prior + 0.14 * category_prior) / 0.94, 1), 5)),
                  struct_pack(head := 'head_bias_prior', p := bias_prior),
                  struct_pack(head := 'head_adaptive', p := least(greatest(CASE WHEN item_n < 10 THEN user_prior ELSE 0.4 * um + 0.6 * im END, 1), 5))], recursive := true) FROM feat)
"""
_ERRORS = "count(*) AS n, round(avg(abs(p - rating)), 6) AS mae, round(sqrt(avg((p - rating) * (p - rating))), 6) AS rmse"

SQL = {
    "covis_recommend_top10": f"{BASE}{_R01} SELECT user_id, item_id, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS k FROM norm n {_UNSEEN}) WHERE k <= 10",
    "s05_interactions": f"{BASE} SELECT review_id, user_id, item_id, name, rating, category, ts FROM inter",
    "s04_items": f"{BASE} SELECT item_id, name, category, summary, average_rating, popularity FROM catalogue",
    "j02_reviewed_items": f"{BASE} SELECT item_id, category FROM catalogue WHERE item_id IN (SELECT item_id FROM inter)",
    "j01_reviews_with_metadata": f"{BASE} SELECT r.review_id, r.item_id, coalesce(c.name, r.name) AS name, coalesce(c.category, r.category) AS category FROM inter r LEFT JOIN catalogue c USING (item_id)",
    "w01_temporal_split": f"{BASE} SELECT review_id, is_test FROM placed",
    "j04_histories": f"{BASE} SELECT user_id, string_agg(item_id, ',' ORDER BY ts, review_id) AS items FROM hist GROUP BY 1",
    "proj07_stride_sample": f"""{BASE}, o AS (SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS ordinal FROM test), m AS (SELECT count(*) AS n FROM test)
        SELECT review_id, ordinal FROM o WHERE ordinal IN (SELECT least((i * n) // least(200, n), n - 1) FROM range(200) r(i), m)""",
    "proj08_shards": f"{BASE} SELECT review_id FROM (SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS i FROM test) WHERE i % 3 = 1",
    "proj09_history_buckets": f"""{BASE}, s AS (SELECT user_id, count(*) AS n FROM hist GROUP BY 1)
        SELECT CASE WHEN n <= 2 THEN 'sparse' WHEN n <= 7 THEN 'medium' ELSE 'warm' END AS ranking_bucket, CASE WHEN n <= 2 THEN 'light' WHEN n <= 9 THEN 'medium' ELSE 'warm' END AS rating_bucket, count(*) AS n_users FROM s GROUP BY 1, 2""",
    "proj16_items_with_popularity": f"{BASE}, l AS (SELECT item_id, count(*) AS c FROM train WHERE rating >= 4 GROUP BY 1) SELECT item_id, coalesce(c, popularity) AS popularity FROM catalogue LEFT JOIN l USING (item_id)",
    "a02_item_rollup": f"{BASE} SELECT item_id, count(*) AS n, avg(rating) AS mean, arg_min(name, struct_pack(ts := ts, review_id := review_id)) AS name, arg_min(category, struct_pack(ts := ts, review_id := review_id)) AS category FROM inter GROUP BY 1",
    "a03_global_stats": _stats(),
    "a03_user_stats": _stats("user_id"),
    "a03_item_stats": _stats("item_id"),
    "a03_category_stats": _stats("category"),
    "a03_user_category_stats": _stats("user_id", "category"),
    "a06_recent_means": f"{BASE}{_FEATURES} SELECT user_id, round(m, 6) AS recent_mean FROM sr",
    "a08_popularity": f"{BASE}, c AS (SELECT item_id, count(*) AS c FROM train WHERE rating >= 4 GROUP BY 1) SELECT item_id, coalesce(c, 0) AS n, row_number() OVER (ORDER BY coalesce(c, 0) DESC, item_id DESC) AS rank FROM catalogue LEFT JOIN c USING (item_id)",
    "a09_popularity_all": f"{BASE}, c AS (SELECT item_id, count(*) AS c FROM train GROUP BY 1) SELECT item_id, coalesce(c, 0) AS n, row_number() OVER (ORDER BY coalesce(c, 0) DESC, item_id DESC) AS rank FROM catalogue LEFT JOIN c USING (item_id)",
    "a10_latest_pairs": f"{BASE} SELECT user_id, item_id, rating, ts FROM liked",
    "a11_user_items": f"{BASE}{_USER_ITEMS} SELECT user_id, item_id, rating, ts, rank FROM ui",
    "a11_item_users": f"{BASE}{_USER_ITEMS} SELECT item_id, user_id, rating, rank FROM iu",
    "j05_covisitation": f"{BASE}{_COVIS} SELECT * FROM neigh",
    "a12_item_terms": f"{BASE}{_TERMS} SELECT item_id, term, score, rank, posting FROM iterms",
    "a12_term_items": f"{BASE}{_TERMS} SELECT * FROM post",
    "a13_bm25_index": f"{BASE}{_BM25} SELECT item_id, term, tf, dl, round(idf, 6) AS idf FROM bi",
    "a14_category_rank": f"{BASE} SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY popularity DESC, coalesce(average_rating, 0) DESC, item_id DESC) AS rank FROM catalogue QUALIFY rank <= 200",
    "a15_transitions": f"{BASE}{_TRANSITIONS} SELECT * FROM tr",
    "a15_aspect_items": f"{BASE}{_ASPECT_ITEMS} SELECT * FROM ai",
    "a19_cosine_neighbors": f"{BASE}{_cosine(20)} SELECT * FROM cosn",
    "a20_user_numbers": f"""{BASE}, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, review_id) AS i, count(*) OVER (PARTITION BY user_id) AS c, len(list_filter(regexp_split_to_array(review, '\\s+'), lambda w: w <> '')) AS wc FROM train)
        SELECT user_id, count(*) AS evidence_count, round(avg(rating), 2) AS average_rating, round(avg(rating) FILTER (i > c - 3), 2) AS recent_average_rating, round(stddev_pop(rating), 3) AS rating_std,
               round(avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END), 3) AS positive_rating_share, round(avg(CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END), 3) AS negative_rating_share,
               round(CASE WHEN count(*) < 4 THEN 0.0 ELSE avg(rating) FILTER (i > c // 2) - avg(rating) FILTER (i <= c // 2) END, 3) AS rating_trend, round(avg(wc), 2) AS review_length_mean,
               CASE WHEN avg(rating) < 3.2 THEN 'strict' WHEN avg(rating) > 4.1 THEN 'generous' ELSE 'balanced' END AS rating_strictness,
               CASE WHEN avg(wc) < 20 THEN 'short, direct, and practical' WHEN avg(wc) > 80 THEN 'detailed and experience-driven' ELSE 'balanced, specific, and conversational' END AS voice_style,
               round(least(0.10 + least(count(*) / 8, 0.75) + CASE WHEN count(DISTINCT round_even(rating, 0)) > 1 THEN 0.10 ELSE 0 END, 0.95), 3) AS confidence
        FROM q GROUP BY user_id""",
    "a21_top_terms": f"{BASE}{_top_terms('train')} SELECT * FROM tt",
    "a21_preferred_categories": f"{BASE}{_PREFERRED.format('train')} SELECT * FROM pref",
    "a21_category_affinity": f"{BASE} SELECT user_id, category, round((avg(rating) - 3) / 2, 3) AS affinity FROM train GROUP BY 1, 2",
    "a22_user_aspects": f"{BASE}{_ua('train')} SELECT * FROM ua",
    "a22_item_aspects": f"{BASE}{_ITEM_ASPECTS} SELECT * FROM ia",
    "a23_dataset_summary": f"""{BASE}, u AS (SELECT user_id, count(*) AS c FROM inter GROUP BY 1)
        SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT (user_id, item_id)) AS n_pairs, (SELECT count(*) FROM u WHERE c <= 2) AS n_sparse_users,
               {", ".join(f"count(*) FILTER (round(rating) = {s}) AS stars_{s}" for s in range(1, 6))}, min(ts) AS min_ts, max(ts) AS max_ts,
               round(count(DISTINCT (user_id, item_id)) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 8) AS density FROM inter""",
    "a25_history_distribution": f"""{BASE}, u AS (SELECT user_id, count(*)::DOUBLE AS v FROM inter GROUP BY 1)
        SELECT count(*) AS n, min(v) AS min, avg(v) AS mean, max(v) AS max, {", ".join(f"quantile_disc(v, {p}) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))} FROM u""",
    "a34_target_ratings": f"{BASE} SELECT CASE WHEN rating >= 4 THEN 'positive' ELSE 'other' END AS kind, count(*) AS n FROM test GROUP BY 1",
    "r01_co_visitation": f"{BASE}{_R01} SELECT * FROM norm n {_UNSEEN}",
    "r02_user_neighbor": f"{BASE}{_R02} SELECT * FROM norm",
    "r03_implicit_item_item": f"{BASE}{_R03} SELECT * FROM norm",
    "r04_review_terms": f"{BASE}{_R04} SELECT * FROM norm",
    "r06_lexical_neighbors": f"{BASE}{_R06} SELECT * FROM norm",
    "r08_evidence_graph": f"{BASE}{_R08} SELECT user_id, item_id, score, source, rank FROM gr",
    "r13_bm25": f"{BASE}{_R13} SELECT * FROM norm",
    "r24_category_popular": f"{BASE}{_R24} SELECT user_id, item_id, score, rank FROM r24",
    "r26_global_popular": f"{BASE}{_R26} SELECT user_id, item_id, round(greatest(1 - (rank - 1) / 35, round(least(CASE WHEN popularity > 0 THEN 0.70 * q + 0.30 ELSE q END, 1), 4)), 4) AS score, rank FROM gr",
    "m03_rating_features": f"{BASE}{_FEATURES} SELECT review_id, rating, user_n, item_n, {', '.join(f'round({c}, 6) AS {c}' for c in ('user_prior', 'user_recent_prior', 'item_prior', 'category_prior', 'user_category_prior', 'bias_prior'))} FROM feat",
    "a27_rating_errors": f"{BASE}{_FEATURES} SELECT head, {_ERRORS} FROM heads GROUP BY 1",
    "a30_rating_slices": f"""{BASE}{_FEATURES}, sl AS (SELECT *, 'history:' || CASE WHEN user_n <= 0 THEN 'cold' WHEN user_n <= 2 THEN 'light' WHEN user_n <= 9 THEN 'medium' ELSE 'warm' END AS slice FROM heads UNION ALL SELECT *, 'category:' || category FROM heads)
        SELECT slice, head, {_ERRORS} FROM sl GROUP BY 1, 2 HAVING count(*) >= 2""",
    "f20_item_profiles": f"""{BASE} SELECT item_id, category, round(coalesce(least(greatest((average_rating - 1) / 4, 0.0), 1.0), 0.65), 6) AS quality_score, popularity,
        array_to_string(list_transform(list_sort(list_transform((SELECT list(DISTINCT x) FROM unnest(regexp_extract_all(lower(vtxt), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}')) z(x)), lambda t: struct_pack(p := list_position(regexp_extract_all(lower(vtxt), '[a-zA-Z][a-zA-Z0-9_-]{{2,}}'), t), t := t)))[1:32], lambda s: s.t), ' ') AS terms FROM catalogue""",
    "j18_prior_features": f"{BASE} SELECT review_id, count(rating) OVER w AS n_prior, round(avg(rating) OVER w, 6) AS mean_prior FROM train WINDOW w AS (PARTITION BY user_id ORDER BY ts, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "proj11_cross_domain": f"{BASE} SELECT review_id, user_id, category FROM test t WHERE user_id IN (SELECT user_id FROM train WHERE rating >= 4) AND NOT EXISTS (SELECT 1 FROM train l WHERE l.rating >= 4 AND l.user_id = t.user_id AND l.category = t.category)",
    "a38_rating_summary": f"{BASE} SELECT category, count(*) AS n, round(avg(rating), 6) AS mean, quantile_cont(rating, 0.5) AS median, min(rating) AS low, max(rating) AS high, {', '.join(f'count(*) FILTER (floor(rating) = {k}) AS n_{k}' for k in range(1, 6))} FROM inter GROUP BY 1",
    "a37_event_metrics": "SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1",
    "z01_last_feedback": "SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1, 2",
    "z04_stream_metrics": "SELECT event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY 1",
}
