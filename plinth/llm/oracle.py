"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_UPPER.lower()}')"


LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), repeated AS (
    SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
    SELECT l.doc_id, l.pos, l.line, r.k IS NULL OR l.doc_id = r.keeper AS stays FROM keyed l LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (
    SELECT item_id, {_WORDS.format(_lower("text"))} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, w[i : i + 9] AS win, len(w[i : i + 9]) AS n
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS.format(_lower("text"))} END AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs
), sizes AS (
    SELECT DISTINCT n FROM windows
), found AS (
    SELECT p.doc_id, p.i, s.n, x.item_id
    FROM places p CROSS JOIN sizes s JOIN windows x ON x.n = s.n AND x.win = p.w[p.i : p.i + s.n - 1]
    WHERE p.i + s.n - 1 <= len(p.w)
), hits AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
       sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""


HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, other AS negative_id, positive_score,
       score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW nearest AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER nearest <= 10
"""

SOURCE_DIVERGENCE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           {_lower("coalesce(text, '')")} AS t
    FROM documents
), terms AS (
    SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), cells AS (
    SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), counts AS (
    SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n,
           1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
           1 + CAST(1000000000 AS HUGEINT) * (lang_n + 5) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
    FROM counts WINDOW g AS (PARTITION BY lang, source)
), distances AS (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""

EXACT_DEDUP = f"""
WITH texts AS (
    SELECT doc_id, {_lower("coalesce(text, '')")} AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""


def statements() -> dict[str, str]:
    return {
        "op1_line_dedup": LINE_DEDUP,
        "op3_decontamination": DECONTAMINATION,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_source_divergence": SOURCE_DIVERGENCE,
        "op13_exact_dedup": EXACT_DEDUP,
    }
