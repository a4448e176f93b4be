"""DuckDB SQL for what SQL can say of the corpus operators' results."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

# The base patterns of personal data.
_BASE = {
    "email": r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'",
    "ip": r"'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'",
    "card": r"'[0-9]([\x20-]?[0-9])+'",
    "phone": r"'\+[0-9][\x20().0-9-]+[0-9]'",
}

_FOUND = " UNION ALL ".join(f"SELECT doc_id, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, {p}) AS ms, regexp_split_to_array(t, {p}) AS ps FROM d" for i, (k, p) in enumerate(_BASE.items()))
_LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(g)[i] AS INT) ELSE (2 * CAST(reverse(g)[i] AS INT)) % 10 + (2 * CAST(reverse(g)[i] AS INT)) // 10 END)) % 10 = 0"

PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
x AS (SELECT doc_id, rank, kind, ms, ps, unnest(ms) AS s, unnest(range(1, len(ms) + 1)) AS i FROM f),
y AS (SELECT doc_id, rank, kind, s, regexp_replace(s, '[^0-9]', '', 'g') AS g,
             CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS a FROM x),
z AS (SELECT * FROM y WHERE CASE kind
        WHEN 'ip' THEN list_bool_and(list_transform(string_split(s, '.'), lambda v: coalesce(try_cast(v AS BIGINT) <= 255, false)))
        WHEN 'card' THEN length(g) BETWEEN 14 AND 19 AND {_LUHN}
        WHEN 'phone' THEN length(g) BETWEEN 10 AND 15 ELSE true END),
b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _BASE)}, string_agg(kind || ':' || a || ':' || (a + length(s)), ',' ORDER BY a, rank) AS spans FROM z GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in _BASE)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN b USING (doc_id)
"""

URL_RULES = f"""
WITH r(host, path) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_UPPER}, {_LOWER}) AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
m AS (SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule FROM u LEFT JOIN m USING (page_id)
"""

REPETITION_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORD}) AS ws FROM d),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS win FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, win FROM k GROUP BY doc_id, win HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM k JOIN g USING (doc_id, win)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""

NEAR_GROUPS = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS shingle FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.other = t.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
