"""DuckDB SQL of the llm queries that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata

from tastegrid.llm.lookalike import LOOKALIKES, WIDTHLESS


def _letters() -> dict[str, str]:
    """Single characters and what they are drawn like: the table, full-width forms, and composed letters of the table's letters."""
    out = LOOKALIKES | {chr(i): chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)}
    for i in range(0x80, 0x3000):
        base, *marks = unicodedata.normalize("NFD", chr(i))
        if marks and base in LOOKALIKES and len(new := unicodedata.normalize("NFC", LOOKALIKES[base] + "".join(marks))) == 1:
            out[chr(i)] = new
    return {k: v for k, v in out.items() if v != "'"}


def _one_form(text: str) -> str:
    """SQL for a text in one form, for comparisons: nothing without width, one kind of blank, look-alike letters as Latin ones, composed accents."""
    letters, widthless = _letters(), r"\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}" + "".join(WIDTHLESS)
    without = f"regexp_replace(nfc_normalize({text}), '[{widthless}]', '', 'g')"
    blanks = rf"replace(regexp_replace({without}, '\p{{Zs}}', ' ', 'g'), chr(65287), chr(39))"
    return f"nfc_normalize(translate(nfc_normalize({blanks}), '{''.join(letters)}', '{''.join(letters.values())}'))"


_BASKETS = """
    WITH b AS (SELECT DISTINCT user_id AS u, item_id AS i FROM reviews
               WHERE rating >= 4 AND rating <= 5 AND user_id IS NOT NULL AND item_id IS NOT NULL),
    n AS (SELECT i, count(*) AS c FROM b GROUP BY i),
    t AS (SELECT count(DISTINCT u) AS users FROM b),
    ab AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM b x JOIN b y ON x.u = y.u AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 4)
"""
_CASES = "FROM ab JOIN n na ON na.i = ab.a JOIN n nb ON nb.i = ab.b, t WHERE ab.c * t.users >= 5 * na.c * nb.c"

_EDGES = """
    WITH e AS (SELECT item_id, neighbor_id, max(score) AS score FROM item_neighbors
               WHERE item_id IS NOT NULL AND neighbor_id IS NOT NULL AND item_id <> neighbor_id AND score IS NOT NULL AND NOT isnan(score)
               GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, neighbor_id) AS rank FROM e)
"""

_WORDS = """
    WITH once AS (SELECT review_id AS r, any_value(split_name) AS s, any_value(review) AS t, any_value(user_id) AS u, any_value(item_id) AS i
                  FROM reviews WHERE review IS NOT NULL AND review_id IS NOT NULL GROUP BY review_id),
    w AS (SELECT *, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM once),
    g AS (SELECT DISTINCT r, s, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS x FROM w WHERE len(ws) >= 20),
    n AS (SELECT r, count(*) AS c FROM g GROUP BY r),
"""

_TERMS = """
    WITH once AS (SELECT review_id, any_value(item_id) AS item, any_value(review) AS t FROM reviews
                  WHERE rating >= 4 AND rating <= 5 AND item_id IS NOT NULL AND review IS NOT NULL AND review_id IS NOT NULL GROUP BY review_id),
    words AS (SELECT item, review_id, unnest(regexp_extract_all(lower(t), '[a-z][a-z0-9_-]{2,}')) AS term FROM once),
    counts AS (SELECT item, term, count(*) AS tf, count(DISTINCT review_id) AS reviews FROM words GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY 1),
    dl AS (SELECT item, sum(tf) AS dl FROM counts GROUP BY 1),
    n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl)
"""

_SPLIT_PAIRS = f"""{_WORDS}
        p AS (SELECT x.r AS e, y.r AS t, count(*) AS c FROM g x JOIN g y ON x.x = y.x WHERE x.s IN ('test_task_a', 'test_task_b') AND y.s = 'train' GROUP BY 1, 2),
        f AS (SELECT p.e, p.t FROM p JOIN n a ON a.r = p.e JOIN n b ON b.r = p.t WHERE 2 * p.c >= a.c + b.c - p.c
              UNION
              SELECT a.r, b.r FROM w a JOIN w b ON a.ws = b.ws AND a.u = b.u AND a.i = b.i
              WHERE a.s IN ('test_task_a', 'test_task_b') AND b.s = 'train' AND len(a.ws) BETWEEN 1 AND 19)"""

_NEAR = f"""{_WORDS}
        p AS (SELECT x.r AS e, y.r AS t, count(*) AS c FROM g x JOIN g y ON x.x = y.x AND x.r < y.r WHERE x.s = 'train' AND y.s = 'train' GROUP BY 1, 2),
        q AS (SELECT p.e, p.t FROM p JOIN n a ON a.r = p.e JOIN n b ON b.r = p.t WHERE 2 * p.c >= a.c + b.c - p.c)"""

_DOCS = f"""
    WITH d AS (SELECT doc_id, text, {_one_form("text")} AS one FROM documents WHERE text IS NOT NULL),
    c AS (SELECT one FROM d WHERE trim(one, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY one HAVING count(DISTINCT text) > 1)
"""


def _spans(table: str, key: str, n: int) -> str:
    words = rf"regexp_extract_all(lower({_one_form('text')}), '[\p{{L}}\p{{N}}]+')"
    return f"SELECT DISTINCT k, list_slice(ws, i, i + {n - 1}) AS s FROM (SELECT {key} AS k, {words} AS ws FROM {table} WHERE text IS NOT NULL), unnest(range(1, len(ws) - {n - 2})) r(i)"


_VECTORS = """
    WITH v AS (SELECT user_id, arg_max(embedding, updated_at) AS e FROM user_profiles WHERE user_id IS NOT NULL AND len(embedding) = 64 GROUP BY user_id),
    ok AS (SELECT user_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    s AS (SELECT a.user_id AS a, b.user_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM ok a JOIN ok b ON a.user_id <> b.user_id)
"""

SQL = {
    "p1_found": f"{_BASKETS} SELECT ab.a AS item_id_a, ab.b AS item_id_b {_CASES}",
    "p1_cooccurrence": f"{_BASKETS} SELECT ab.a AS item_a, ab.b AS item_b, ab.c AS n_ab, na.c AS n_a, nb.c AS n_b, t.users AS n_baskets, (ab.c * t.users)::DOUBLE / (na.c * nb.c) AS lift {_CASES}",
    "p2_found": f"{_EDGES} SELECT item_id, neighbor_id FROM r WHERE rank <= 10",
    "p2_top10": f"{_EDGES} SELECT item_id, neighbor_id, score, rank::INT AS rank FROM r WHERE rank <= 10",
    "p3_found": f"{_SPLIT_PAIRS} SELECT DISTINCT least(e, t) AS review_id_a, greatest(e, t) AS review_id_b FROM f",
    "p3_report": f"""{_SPLIT_PAIRS}, own AS (SELECT DISTINCT review_id AS e, split_name, feed FROM reviews WHERE review_id IS NOT NULL AND split_name <> 'train')
        SELECT split_name, feed, count(DISTINCT f.e) AS n_records, count(DISTINCT (f.e, f.t)) AS n_pairs, count(*) FILTER (a.ws = b.ws) AS n_exact
        FROM f JOIN own USING (e) JOIN w a ON a.r = f.e JOIN w b ON b.r = f.t GROUP BY 1, 2""",
    "p4_found": f"""{_TERMS},
        r AS (SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY (1 + ln(tf)) * ln(1 + n / (1 + df)) DESC, term) AS k
              FROM counts JOIN df USING (term), n WHERE reviews >= 3 AND 20 * df <= n)
        SELECT item AS item_id, term FROM r WHERE k <= 3""",
    "p4_terms": f"""{_TERMS},
        v AS (SELECT item, term, cf / n AS rate, tf * log2(1 + avgdl / dl) AS tfn FROM counts JOIN df USING (term) JOIN dl USING (item), n),
        x AS (SELECT item, term, (log2(1 + rate) + tfn * log2(1 + 1 / rate)) / (1 + tfn) AS weight FROM v)
        SELECT item AS item_id, term, round(weight, 4) AS score, row_number() OVER (PARTITION BY item ORDER BY round(weight, 9) DESC, term)::INT AS rank FROM x QUALIFY rank <= 18""",
    "p5_found": f"{_VECTORS} SELECT a AS user_id_a, b AS user_id_b FROM s WHERE c >= 0.9 AND a < b",
    "p5_neighbours": f"{_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s) SELECT a AS id, b AS neighbor_id, round(c, 6) AS similarity FROM r WHERE k <= 5",
    "p6_found": f"{_NEAR} SELECT e AS review_id_a, t AS review_id_b FROM q",
    "p6_links": f"""{_NEAR}, k AS (SELECT r, ws FROM w WHERE s = 'train' AND len(ws) >= 20),
        l AS (SELECT DISTINCT a.ws AS x, b.ws AS y FROM q JOIN k a ON a.r = q.e JOIN k b ON b.r = q.t WHERE a.ws <> b.ws),
        d AS (SELECT ws, count(*) AS n FROM (SELECT x AS ws, y AS o FROM l UNION SELECT y, x FROM l) GROUP BY 1)
        SELECT k.r AS review_id, coalesce(d.n, 0) AS n_links FROM k LEFT JOIN d USING (ws) WHERE k.r IN (SELECT e FROM q UNION SELECT t FROM q)""",
    "p6_groups": f"""WITH RECURSIVE {_NEAR.strip().removeprefix("WITH")},
        k AS (SELECT r, min(r) OVER (PARTITION BY ws) AS m FROM w WHERE s = 'train' AND len(ws) > 0),
        e AS (SELECT DISTINCT a.m AS x, b.m AS y FROM q JOIN k a ON a.r = q.e JOIN k b ON b.r = q.t WHERE a.m <> b.m),
        both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        reach AS (SELECT DISTINCT x AS o, x AS z FROM both_ways UNION SELECT reach.o, b.y FROM reach JOIN both_ways b ON b.x = reach.z),
        root AS (SELECT o, min(z) AS g FROM reach GROUP BY 1)
        SELECT i.r AS review_id, coalesce(root.g, k.m, i.r) AS group_id FROM (SELECT DISTINCT review_id AS r FROM reviews WHERE split_name = 'train' AND review_id IS NOT NULL) i
        LEFT JOIN k ON k.r = i.r LEFT JOIN root ON root.o = k.m""",
    "p8_found": f"SELECT DISTINCT a.k AS doc_id, b.k AS passage_id FROM ({_spans('documents', 'doc_id', 13)}) a JOIN ({_spans('eval_passages', 'passage_id', 13)}) b ON a.s = b.s",
    "p10_found": f"{_DOCS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.one = b.one AND a.doc_id < b.doc_id AND a.text <> b.text WHERE a.one IN (SELECT one FROM c)",
    "p10_classes": f"{_DOCS} SELECT doc_id, min(doc_id) OVER (PARTITION BY one) AS class_id, n_forms FROM d JOIN (SELECT one, count(DISTINCT text) AS n_forms FROM d GROUP BY 1) USING (one) WHERE one IN (SELECT one FROM c)",
}
