"""DuckDB SQL of the operators' queries that SQL can express."""

from __future__ import annotations

#: The masks by direct evaluation, every order played step by step, Shapley as the plain sum of
#: removals over all orders.
FILTER_AUDIT = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), firsts AS (
    SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN words.doc_id > first_id THEN 16 ELSE 0 END) AS mask
    FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN flags ON words.doc_id = flags.doc_id
), masks AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
    SELECT a.c || b.c || d.c || e.c || f.c AS filter_order
    FROM letters a, letters b, letters d, letters e, letters f
    WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5
), steps AS (
    SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
           coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)]), 0)::INT AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), played AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM played
"""

#: The tree with DuckDB's own pattern matching and digests, the next document by a window.
MERKLE = r"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), pairs AS (
    SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM base WINDOW w AS (ORDER BY doc_id DESC)
), texts AS (
    SELECT doc_id, t, nt, left(t, (length(t) - length(t) // 2)::INT) || left(nt, (length(t) // 2)::INT) AS e FROM pairs
), long AS (
    SELECT doc_id, 't' AS k, t AS x FROM texts UNION ALL SELECT doc_id, 'e', e FROM texts UNION ALL SELECT doc_id, 'n', nt FROM texts
), pieces AS (
    SELECT doc_id, k, x, regexp_extract_all(x, '[^.!?\n]{1,64}[.!?]*\n*|[.!?]+\n*|\n+') AS p FROM long
), leaves AS (
    SELECT doc_id, k, x, list_transform(p, lambda q: left(md5(q), 13) || lpad(least(length(q), 99)::VARCHAR, 2, '0')
        || CASE WHEN q NOT LIKE '%' || chr(10) THEN '.' WHEN q LIKE '%' || chr(10) || chr(10) OR md5(q)[1] IN ('0', '1') THEN ';' ELSE ',' END) AS l
    FROM pieces
), sections AS (
    SELECT doc_id, k, x, l, list_transform(list_filter(string_split(array_to_string(l, ''), ';'), lambda s: s <> ''), lambda s:
        left(sha256(array_to_string(list_transform(list_filter(string_split(s, ','), lambda c: c <> ''), lambda c: sha256(c)), ',')), 16) || '=' || s) AS s
    FROM leaves
), marks AS (
    SELECT doc_id, k, x, l, sha256(array_to_string(list_transform(s, lambda c: left(c, 16)), ';')) || ':' || array_to_string(s, ';') AS f FROM sections
), sized AS (
    SELECT doc_id, k, x, l, f, list_sum(list_transform(list_distinct(l), lambda c: c[14:15]::INT)) AS n FROM marks
), likened AS (
    SELECT a.doc_id, b.k, CASE WHEN a.l = b.l THEN 1.0::DOUBLE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) = 0 THEN 0.0::DOUBLE
        ELSE 2 * coalesce(list_sum(list_transform(list_intersect(a.l, b.l), lambda c: c[14:15]::INT)), 0)::DOUBLE / (coalesce(a.n, 0) + coalesce(b.n, 0)) END AS near
    FROM sized a JOIN sized b ON a.doc_id = b.doc_id AND a.k = 't' AND b.k <> 't'
)
SELECT o.doc_id, length(o.x)::BIGINT AS n_chars, sha256(e.x) AS edited_sha256, o.f AS fingerprint, e.f AS edited_fingerprint,
       ne.near AS near_edited, nn.near AS near_next
FROM sized o JOIN sized e ON o.doc_id = e.doc_id AND o.k = 't' AND e.k = 'e'
JOIN likened ne ON ne.doc_id = o.doc_id AND ne.k = 'e' JOIN likened nn ON nn.doc_id = o.doc_id AND nn.k = 'n'
"""
