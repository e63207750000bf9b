"""DuckDB SQL of the candidate pool, its metrics and the smaller text and file queries, written independently of the operators."""

from __future__ import annotations

from tastegrid.functions.words import ASPECT_STOPWORDS, FAMILY_CONFIDENCE, SOURCES
from tastegrid.plans.engine_sql import _BM25, _COVIS, _ERRORS, _FEATURES, _PREFERRED, _R08, _ITEM_ASPECTS, _UNSEEN, BASE, SQL as ENGINE, _list, _top_terms, _ua

_POP = "popularity DESC, coalesce(average_rating, 0) DESC, item_id DESC"
_Q = "coalesce(nullif(average_rating, 0), 3.5) / 5"
_TOKEN = "[a-zA-Z][a-zA-Z0-9_-]{2,}"

_CW = (
    _PREFERRED.format("hist")
    + """,
    aff AS (SELECT user_id, category, (avg(rating) - 3) / 2 AS a FROM hist GROUP BY 1, 2),
    cw AS (SELECT p.user_id, p.category, greatest(greatest(1 - 0.08 * (p.rank - 1), 0.65), least(0.65 + coalesce(a, 0), 1.0)) AS w FROM pref p LEFT JOIN aff ON aff.user_id = p.user_id AND aff.category = p.category),
    nh AS (SELECT user_id, count(*) AS n FROM hist GROUP BY 1)
"""
)

R18 = f"""{BASE}{_CW}{_top_terms("hist")},
    useful AS (SELECT DISTINCT user_id, term FROM tt WHERE mood = 'liked' AND NOT list_contains({_list(ASPECT_STOPWORDS)}, term)),
    wd AS (SELECT *, list_distinct(regexp_extract_all(lower(txt), '{_TOKEN}')) AS ts FROM catalogue),
    po AS (SELECT category, term, item_id, row_number() OVER (PARTITION BY category, term ORDER BY {_POP}) AS place FROM (SELECT *, unnest(ts) AS term FROM wd) QUALIFY place <= 300),
    hi AS (SELECT u.user_id, p.item_id, round(sum(w / sqrt(place)), 9) AS raw FROM useful u JOIN cw ON cw.user_id = u.user_id JOIN po p ON p.category = cw.category AND p.term = u.term GROUP BY 1, 2),
    ul AS (SELECT user_id, list(term) AS us FROM useful GROUP BY 1),
    sc AS (SELECT user_id, item_id, popularity, average_rating, round(greatest(least(0.50 * least(raw / max(raw) OVER (PARTITION BY user_id), 1.0) + 0.24 * (len(list_intersect(us, ts)) / len(us)) + 0.16 * ({_Q})
                  + 0.10 * CASE WHEN popularity > 0 THEN least(ln(1 + popularity) / ln(501), 1.0) ELSE 0 END, 1.0), 0.0), 4) AS score FROM hi JOIN wd USING (item_id) JOIN ul USING (user_id)),
    pl AS (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {_POP}) AS rank FROM sc n {_UNSEEN})
    SELECT user_id, item_id, score, rank FROM pl JOIN nh USING (user_id) WHERE rank <= CASE WHEN n <= 2 THEN 26 ELSE 16 END"""

R22 = f"""{BASE}{_CW},
    rk AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_POP}) - 1 AS place FROM catalogue QUALIFY place < 2000),
    st AS (SELECT category, greatest(1, count(*) // 12) AS stride FROM rk GROUP BY 1),
    pk AS (SELECT rk.*, place // stride AS pick FROM rk JOIN st USING (category) WHERE place % stride = 0 AND place // stride < 12),
    sc AS (SELECT cw.user_id, pk.item_id, popularity, average_rating, round(greatest(least(0.60 * w + 0.25 * ({_Q}) + 0.15 * (1 - pick / 12), 1.0), 0.0), 4) AS score
           FROM cw JOIN nh ON nh.user_id = cw.user_id AND nh.n <= 2 JOIN pk ON pk.category = cw.category)
    SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, {_POP}) AS rank FROM sc n {_UNSEEN} QUALIFY rank <= 8"""

_R13_UNSEEN = f"""{BASE}{_BM25}{_top_terms("hist")},
    bq AS (SELECT q.user_id, b.item_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS raw FROM tt q JOIN bi b USING (term) WHERE q.mood = 'liked' GROUP BY 1, 2),
    bs AS (SELECT *, round(least(raw / max(raw) OVER (PARTITION BY user_id), 1.0), 4) AS score FROM bq)
    SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, item_id) AS rank FROM bs n {_UNSEEN} QUALIFY rank <= 35"""

_GRAPH = f"""{BASE}{_R08}, gz AS (SELECT user_id, count(*) AS n FROM hist GROUP BY 1)
    SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id, source ORDER BY rank) AS rank, source FROM gr JOIN gz USING (user_id) WHERE rank <= CASE WHEN n <= 2 THEN 48 ELSE 36 END"""

_SINGLE = {
    "co_visitation": ENGINE["r01_co_visitation"],
    "user_neighbor": ENGINE["r02_user_neighbor"],
    "implicit_item_item": ENGINE["r03_implicit_item_item"],
    "review_term_profile": ENGINE["r04_review_terms"],
    "lexical_item_neighbor": ENGINE["r06_lexical_neighbors"],
    "bm25_profile": _R13_UNSEEN,
    "aspect_profile": R18,
    "sparse_category_tail": R22,
    "category_affinity_popular": ENGINE["r24_category_popular"],
    "global_popular": ENGINE["r26_global_popular"],
}
_EXPLORING = "('aspect_profile', 'sparse_category_tail')"


def pool(masks: dict[str, tuple[str, ...]]) -> str:
    """CTEs ``s1`` (mask, user_id, item_id, score, rank, source) and ``pool`` (mask, ..., stage, rank) over the masks of sources left out."""
    union = " UNION ALL ".join([f"SELECT user_id, item_id, score, rank, '{n}' AS source FROM ({q})" for n, q in _SINGLE.items()] + [f"SELECT * FROM ({_GRAPH})"])
    left = ", ".join(f"('{m}', '{s}')" for m, names in masks.items() for s in names) or "('-', '-')"
    named = ", ".join(f"('{m}')" for m in masks)
    known = ", ".join(f"('{s}', {p}, {0.12 * FAMILY_CONFIDENCE[f]!r}::DOUBLE)" for s, (f, p) in SOURCES.items())
    lexical, spare = "('review_term_profile', 'lexical_item_neighbor', 'bm25_profile')", "('category_affinity_popular', 'category_popular', 'sparse_category_tail')"
    best = "priority DESC, popularity DESC, coalesce(average_rating, 0) DESC, item_id"

    def place(flag: str, order: str) -> str:
        return f"CASE WHEN {flag} THEN row_number() OVER (PARTITION BY mask, user_id, {flag} ORDER BY {order}) END"

    return f"""{BASE}{_PREFERRED.format("hist")},
    s0 AS MATERIALIZED ({union}),
    mk AS (SELECT * FROM (VALUES {named}) v(mask)), gone AS (SELECT * FROM (VALUES {left}) v(mask, source)), prio AS (SELECT * FROM (VALUES {known}) v(source, p, c)),
    l0 AS (SELECT mk.mask, s0.* FROM mk, s0 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.mask = mk.mask AND g.source = s0.source)),
    taken AS (SELECT mask, user_id, count(DISTINCT item_id) AS n FROM l0 WHERE source <> 'global_popular' GROUP BY 1, 2),
    cr AS (SELECT category, item_id, row_number() OVER (PARTITION BY category ORDER BY {_POP}) AS place,
                  round(least(CASE WHEN popularity > 0 THEN 0.70 * ({_Q}) + 0.30 ELSE {_Q} END, 1.0), 4) AS score FROM catalogue QUALIFY place <= 200),
    cf AS (SELECT n.user_id, cr.item_id, cr.score, row_number() OVER (PARTITION BY n.user_id ORDER BY n.rank, cr.place) AS rank FROM pref n JOIN cr ON cr.category = n.category
           WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = n.user_id AND h.item_id = cr.item_id) QUALIFY rank <= 60),
    s1 AS (SELECT mask, user_id, item_id, score, rank, source FROM l0
           UNION ALL SELECT mk.mask, cf.user_id, cf.item_id, cf.score, cf.rank, 'category_popular' FROM mk CROSS JOIN cf LEFT JOIN taken t ON t.mask = mk.mask AND t.user_id = cf.user_id
           WHERE cf.rank <= 60 - coalesce(t.n, 0) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.mask = mk.mask AND g.source = 'category_popular')),
    hs AS (SELECT user_id, count(*) AS n FROM hist GROUP BY 1),
    mg AS (SELECT mask, user_id, item_id, count(DISTINCT source) AS n_sources, round(max(p + c * greatest(least(score, 1.0), 0.0)) + 0.025 * least(count(DISTINCT source), 4), 6) AS priority,
                  max(score) FILTER (source = 'user_neighbor') AS un, max(score) FILTER (source = 'implicit_item_item') AS ii, bool_or(source = 'global_popular') AS gp,
                  bool_or(source IN {spare}) AS sf, bool_or(source IN {lexical}) AS lx, bool_or(source NOT IN {_EXPLORING}) AS pr FROM s1 JOIN prio USING (source) GROUP BY 1, 2, 3),
    full_ AS (SELECT mg.*, popularity, average_rating, un IS NOT NULL AS hu, ii IS NOT NULL AS hi, coalesce(hs.n, 0) <= 2 AS few FROM mg JOIN catalogue USING (item_id) LEFT JOIN hs USING (user_id)),
    pl AS (SELECT *, {place("gp", _POP)} AS k1, {place("sf", best)} AS k2, {place("lx", best)} AS k3, {place("hi", "ii DESC, " + _POP)} AS k4, {place("hu", "un DESC, " + _POP)} AS k5 FROM full_),
    fl AS (SELECT *, list_min(list_filter([CASE WHEN k1 <= (CASE WHEN few THEN 30 ELSE 20 END) THEN (CASE WHEN few THEN 1 ELSE 4 END) * 1000 + k1 END, CASE WHEN few AND k2 <= 12 THEN 2000 + k2 END,
                  CASE WHEN k3 <= (CASE WHEN few THEN 12 ELSE 7 END) THEN 3000 + k3 END, CASE WHEN k4 <= 8 THEN (CASE WHEN few THEN 4 ELSE 2 END) * 1000 + k4 END,
                  CASE WHEN k5 <= 5 THEN (CASE WHEN few THEN 5 ELSE 1 END) * 1000 + k5 END], lambda x: x IS NOT NULL)) AS f FROM pl),
    fr AS (SELECT *, f IS NULL AND pr AS fp, f IS NULL AND NOT pr AS fo, count(f) OVER (PARTITION BY mask, user_id) AS nf FROM fl),
    fk AS (SELECT *, {place("fp", best)} AS kp, {place("fo", best)} AS ko FROM fr),
    at_ AS (SELECT *, coalesce(f, CASE WHEN nf + kp <= 90 THEN 6000 + kp WHEN ko IS NOT NULL THEN 7000 + ko ELSE 8000 + kp END) AS z FROM fk),
    pool AS MATERIALIZED (SELECT mask, user_id, item_id, n_sources, priority, z // 1000 AS stage, row_number() OVER (PARTITION BY mask, user_id ORDER BY z) AS rank FROM at_ QUALIFY rank <= 100)
"""


_ALL = pool({"all": ()})
_TARGETS = "tg AS (SELECT mk.mask, t.user_id, t.item_id, t.category, p.rank FROM mk CROSS JOIN test t LEFT JOIN pool p ON p.mask = mk.mask AND p.user_id = t.user_id AND p.item_id = t.item_id)"


def _hits(ks: tuple[int, ...]) -> str:
    return "count(*) AS n, " + ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1.0) ELSE 0.0 END), 6) AS ndcg_{k}" for k in ks)


def ablation(masks: dict[str, tuple[str, ...]], base: tuple[str, ...]) -> str:
    built = {*_SINGLE, "category_popular", "sequential_transition", "category_transition", "aspect_evidence_graph", "category_aspect_graph"}
    absent = " ".join(f"WHEN '{m}' THEN '{','.join(n for n in names if n not in built)}'" for m, names in masks.items())
    return f"{pool({m: (*names, *base) for m, names in masks.items()})}, {_TARGETS} SELECT mask AS left_out, {_hits((10, 100))}, CASE mask {absent} END AS not_run FROM tg GROUP BY mask"


_VALUE = "sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(n)))"


def hashed(rows: str, key: str, name: str) -> str:
    """CTE ``name`` (key, slot, v): unit vectors of the hashed terms of ``rows`` (key, term)."""
    return f""",
    {name}1 AS (SELECT {key}, term, count(*) AS n, sha256(term) AS h FROM ({rows}) GROUP BY 1, 2),
    {name}2 AS (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS slot, {_VALUE} AS v FROM {name}1 GROUP BY 1, 2),
    {name} AS (SELECT {key}, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 6) AS v FROM {name}2 QUALIFY sum(v * v) OVER (PARTITION BY {key}) > 0)"""


def _best(*sources: str) -> str:
    return "greatest(" + ", ".join(f"coalesce(max(score) FILTER (source = '{n}'), 0)" for n in sources) + ")"


_FAMILIES: dict[str, list[str]] = {}
for _name, (_family, _) in SOURCES.items():
    _FAMILIES.setdefault(_family, []).append(_name)
_FIRST = "list_filter(x, lambda v, i: list_position(x, v) = i)"

RANKED = f"""{_ALL}{_top_terms("hist")},
    lt AS (SELECT user_id, coalesce(list(term ORDER BY rank) FILTER (mood = 'liked'), []) AS lk, coalesce(list(term ORDER BY rank) FILTER (mood = 'disliked'), []) AS dk FROM tt GROUP BY 1),
    it AS (SELECT item_id, category, popularity, round(coalesce(least(greatest((average_rating - 1) / 4, 0.0), 1.0), 0.65), 6) AS qs, ({_FIRST})[1:32] AS its FROM (SELECT *, regexp_extract_all(lower(vtxt), '{_TOKEN}') AS x FROM catalogue)),
    cn AS (SELECT user_id, round(least(0.10 + least(count(*) / 8, 0.75) + CASE WHEN count(DISTINCT round_even(rating, 0)) > 1 THEN 0.10 ELSE 0 END, 0.95), 3) AS confidence FROM hist GROUP BY 1),
    af AS (SELECT user_id, category, round((avg(rating) - 3) / 2, 3) AS a FROM hist GROUP BY 1, 2)
    {hashed(f"SELECT user_id, unnest(regexp_extract_all(lower(concat_ws(' ', name, category, review)), '{_TOKEN}')) AS term FROM hist WHERE rating >= 4", "user_id", "hu")}
    {hashed(f"SELECT item_id, unnest(regexp_extract_all(lower(vtxt), '{_TOKEN}')) AS term FROM catalogue", "item_id", "hv")}
    {_ITEM_ASPECTS}{_ua("hist")},
    sf AS (SELECT user_id, item_id, {_best("sequential_transition", "category_transition")} AS sq, {_best("aspect_evidence_graph", "category_aspect_graph")} AS eg, {_best("co_visitation", "implicit_item_item", "user_neighbor")} AS cb,
                  greatest({", ".join(f"least({_best(*names)}, 1.0) * {FAMILY_CONFIDENCE[f]}" for f, names in _FAMILIES.items())}) AS rm FROM s1 GROUP BY 1, 2),
    dt AS (SELECT p.user_id, p.item_id, sum(hu.v * hv.v) AS d FROM pool p JOIN hu ON hu.user_id = p.user_id JOIN hv ON hv.item_id = p.item_id AND hv.slot = hu.slot GROUP BY 1, 2),
    am AS (SELECT p.user_id, p.item_id, round(least(sum(least(ua.score, greatest(coalesce(ia.score, 0), 0))) / sum(ua.score), 1.0), 4) AS m FROM pool p JOIN ua ON ua.user_id = p.user_id AND ua.score > 0
           LEFT JOIN ia ON ia.item_id = p.item_id AND ia.aspect = ua.aspect GROUP BY 1, 2),
    ft AS (SELECT p.user_id, p.item_id, coalesce(confidence, 0.1) AS confidence, qs, sq, greatest(eg, sq) AS eg, greatest(cb, sq) AS cb, rm, greatest(coalesce(d, 0), 0) AS vm, coalesce(m, 0) AS am,
                  CASE WHEN it.popularity > 0 THEN ln(1 + it.popularity) / ln(1 + max(it.popularity) OVER (PARTITION BY p.user_id)) ELSE 0 END AS pp,
                  CASE WHEN pref.user_id IS NOT NULL THEN 1.0 ELSE greatest(coalesce(a, 0), 0) END AS cm,
                  coalesce(CASE WHEN len(lk) > 0 AND len(its) > 0 THEN len(list_filter(lk, lambda x: list_contains(its, x))) / len(lk) END, 0) AS pm,
                  coalesce(CASE WHEN len(dk) > 0 AND len(its) > 0 THEN len(list_filter(dk, lambda x: list_contains(its, x))) / len(dk) END, 0) AS dm
           FROM pool p JOIN it USING (item_id) LEFT JOIN lt ON lt.user_id = p.user_id LEFT JOIN cn ON cn.user_id = p.user_id LEFT JOIN af ON af.user_id = p.user_id AND af.category = it.category
           LEFT JOIN pref ON pref.user_id = p.user_id AND pref.category = it.category LEFT JOIN sf ON sf.user_id = p.user_id AND sf.item_id = p.item_id
           LEFT JOIN dt ON dt.user_id = p.user_id AND dt.item_id = p.item_id LEFT JOIN am ON am.user_id = p.user_id AND am.item_id = p.item_id),
    rw AS (SELECT *, least(greatest((confidence - 0.45) / 0.80, 0.02), 0.65)::DOUBLE AS g FROM ft),
    fs AS (SELECT user_id, item_id, round((1 - g) * (0.85 * pp + 0.10 * qs + 0.05 * 0.65) + g * (0.24 * pm + 0.18 * cm + 0.18 * vm + 0.14 * qs + 0.18 * pp + 0.06 * 0.65 + 0.04 * confidence + 0.16 * am + 0.12 * sq + 0.12 * eg + 0.22 * cb + 0.04 * rm - 0.30 * dm), 9) AS raw FROM rw)
    SELECT user_id, item_id, round(raw, 4) AS raw_score, round(greatest(least(raw, 1.0), 0.0), 2) AS score, row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, item_id) AS rank FROM fs QUALIFY rank <= 10"""

_BLENDED = ("head_user", "head_item", "head_calibrated", "head_bias_prior", "head_adaptive")
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
BLEND = f"""{BASE}{_FEATURES.replace("heads AS (SELECT rating, user_n,", "heads AS (SELECT review_id, rating, user_n,")},
    wd AS (SELECT review_id, any_value(rating) AS y, {", ".join(f"any_value(p) FILTER (head = '{h}') AS h{i}" for i, h in enumerate(_BLENDED))} FROM heads GROUP BY 1),
    mo AS (SELECT avg(y * y) AS c, {", ".join(f"avg(h{i} * h{j}) AS g{i}{j}" for i, j in _PAIRS)}, {", ".join(f"avg(h{i} * y) AS b{i}" for i in range(5))} FROM wd),
    gr AS (SELECT a.v AS w0, b.v AS w1, c.v AS w2, d.v AS w3, 20 - a.v - b.v - c.v - d.v AS w4 FROM range(21) a(v), range(21) b(v), range(21) c(v), range(21) d(v) WHERE a.v + b.v + c.v + d.v <= 20),
    er AS (SELECT gr.*, c + ({" + ".join(f"{1 if i == j else 2} * w{i} * w{j} * g{i}{j}" for i, j in _PAIRS)}) / 400.0 - ({" + ".join(f"2 * w{i} * b{i}" for i in range(5))}) / 20.0 AS e FROM gr, mo),
    be AS (SELECT * FROM er WHERE e <= (SELECT min(e) FROM er) + 1e-10 ORDER BY w0, w1, w2, w3 LIMIT 1),
    al AS (SELECT head, rating, p FROM heads UNION ALL SELECT 'head_blend', y, (w0 * h0 + w1 * h1 + w2 * h2 + w3 * h3 + w4 * h4) / 20.0 FROM wd, be)
    SELECT head, {_ERRORS} FROM al GROUP BY 1"""

LIMITED = """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    f AS (SELECT key, i, [t] AS hits, true AS ok FROM e WHERE i = 1
          UNION ALL SELECT key, i, CASE WHEN len(recent) < 5 THEN list_append(recent, t) ELSE recent END, len(recent) < 5 FROM
              (SELECT e.key, e.i, e.t, list_filter(f.hits, lambda h: h > e.t - 86400) AS recent FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1))
    SELECT key, count(*) AS n, count(*) FILTER (ok) AS n_allowed FROM f GROUP BY 1"""

_BUCKET = "CASE WHEN n <= 2 THEN 'sparse' WHEN n <= 7 THEN 'medium' ELSE 'warm' END"

SQL = {
    "r18_aspect_profile": R18,
    "r22_sparse_tail": R22,
    "u02_candidate_pool": f"{_ALL} SELECT user_id, item_id, n_sources, priority, stage, rank FROM pool",
    "g06_ranked_top10": RANKED,
    "m10_blend": BLEND,
    "z03_rate_limit": LIMITED,
    "a28_ranking_metrics": f"""{_ALL}, {_TARGETS},
        us AS (SELECT user_id, count(*) AS n, list(DISTINCT category) FILTER (rating >= 4) AS liked FROM hist GROUP BY 1),
        sl AS (SELECT tg.*, unnest(list_filter(['all', {_BUCKET.replace("n <=", "coalesce(n, 0) <=")}, CASE WHEN len(liked) > 0 AND NOT list_contains(liked, category) THEN 'cross_domain' END], lambda x: x IS NOT NULL)) AS slice FROM tg LEFT JOIN us USING (user_id))
        SELECT slice, {_hits((10, 50, 100))} FROM sl GROUP BY 1""",
    "a33_miss_causes": f"""{_ALL}, {_TARGETS}{_COVIS},
        us AS (SELECT user_id, count(*) AS n, list(DISTINCT category) FILTER (rating >= 4) AS liked FROM hist GROUP BY 1),
        lk AS (SELECT item_id, count(*) AS c FROM train WHERE rating >= 4 GROUP BY 1),
        ca AS (SELECT coalesce(us.n, 0) AS n, list_filter([CASE WHEN coalesce(c, 0) = 0 THEN 'target_absent_from_positive_train' WHEN c <= 2 THEN 'target_sparse_in_train' END,
                      CASE WHEN NOT coalesce(list_contains(liked, category), false) THEN 'cross_domain_or_no_category_affinity' END,
                      CASE WHEN item_id NOT IN (SELECT item_id FROM neigh) THEN 'no_item_neighbor_path' END, CASE WHEN tg.rank IS NULL THEN 'base_retrieval_miss' END], lambda x: x IS NOT NULL) AS cs
               FROM tg LEFT JOIN us USING (user_id) LEFT JOIN lk USING (item_id)),
        ex AS (SELECT n, unnest(CASE WHEN len(cs) > 0 THEN cs ELSE ['ranker_miss'] END) AS cause FROM ca)
        SELECT cause, {_BUCKET} AS bucket, count(*) AS n FROM ex GROUP BY 1, 2""",
    "a32_source_diagnostics": f"""{_ALL}, nt AS (SELECT greatest(count(*), 1) AS n FROM test),
        fam AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{f}', {str(s in {*_SINGLE, 'category_popular', 'sequential_transition', 'category_transition', 'aspect_evidence_graph', 'category_aspect_graph'}).lower()})" for s, (f, _) in SOURCES.items())}) v(source, family, ran)),
        ct AS (SELECT source, count(*) AS nc, count(DISTINCT s1.user_id) AS nu, count(*) FILTER (t.user_id IS NOT NULL AND s1.rank <= 50) AS h50, count(*) FILTER (t.user_id IS NOT NULL AND s1.rank <= 100) AS h100
               FROM s1 LEFT JOIN test t ON t.user_id = s1.user_id AND t.item_id = s1.item_id GROUP BY 1)
        SELECT fam.source, family, ran, CASE WHEN ran THEN coalesce(nc, 0) END AS n_candidates, CASE WHEN ran THEN coalesce(nu, 0) END AS n_users, CASE WHEN ran THEN coalesce(h50, 0) END AS hits_50, CASE WHEN ran THEN coalesce(h100, 0) END AS hits_100,
               round(CASE WHEN ran THEN coalesce(h50, 0) END / nt.n, 6) AS recall_50, round(CASE WHEN ran THEN coalesce(h100, 0) END / nt.n, 6) AS recall_100 FROM fam LEFT JOIN ct USING (source), nt""",
    "a35_merged_shards": f"""{BASE}{_FEATURES.replace("heads AS (SELECT rating, user_n,", "heads AS (SELECT user_id, rating, user_n,").replace("f0 AS (SELECT t.review_id,", "f0 AS (SELECT t.review_id, t.user_id,")},
        sh AS (SELECT ('0x' || substr(sha256(user_id), 1, 2))::INT % 4 AS s, head, {_ERRORS} FROM heads WHERE head = 'head_calibrated' GROUP BY 1, 2)
        SELECT head, sum(n)::BIGINT AS n, round(sum(mae * n) / sum(n), 4) AS mae FROM sh GROUP BY 1""",
    "f09_hashed_vectors": f"""{BASE}, tk AS (SELECT item_id, unnest(regexp_extract_all(lower(txt0), '{_TOKEN}')) AS term FROM (SELECT *, concat_ws(' ', name, category, summary, array_to_string(map_values(metadata), ' ')) AS txt0 FROM catalogue)),
        ct AS (SELECT item_id, term, count(*) AS n, sha256(term) AS h FROM tk GROUP BY 1, 2),
        sl AS (SELECT item_id, (('0x' || substr(h, 1, 8))::BIGINT % 64)::INT AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(n))) AS v FROM ct GROUP BY 1, 2)
        SELECT item_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM sl QUALIFY sum(v * v) OVER (PARTITION BY item_id) > 0 AND round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) <> 0""",
}
