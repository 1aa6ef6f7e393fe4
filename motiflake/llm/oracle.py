"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES
from . import urls

FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), l AS (
  SELECT conv_id, turn, role, text, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role)
    + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + 15 AS n,
    replace(replace(replace(replace(replace(role, '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c'), chr(10), '\n') AS er,
    replace(replace(replace(text, '\', '\s'), '#', '\h'), '<', '\l') AS et FROM c
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, er, et)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({FOLDED}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS x FROM s),
links AS (
  SELECT p.a, p.b FROM (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2
  ) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP4 = rf"""
WITH r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'),
  ('block', 'example.net/de/8'), ('block', 'org/es/')),
rules AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM r),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT page_id, max_by({{'rule': rule, 'verdict': verdict}}, [length(rule), length(rh)]) AS best
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
w(t, l, e) AS (SELECT unnest(string_split('{' '.join(urls.TRADES)}', ' ')), l, e FROM (SELECT unnest(string_split('{' '.join(urls.LURES)}', ' ')) AS l), (SELECT unnest(string_split('{' '.join(urls.ENDINGS)}', ' ')) AS e)),
b(h) AS (SELECT t || '-' || l || '.' || e FROM w UNION ALL SELECT l || '-' || t || '.' || e FROM w),
x(page_id) AS (SELECT DISTINCT page_id FROM (SELECT page_id, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS h FROM p) JOIN b USING (h))
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict,
  CASE WHEN page_id IN (SELECT page_id FROM x) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""

LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = rf"""
WITH ph(words, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
tp(label, text) AS (VALUES {", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)}),
ts AS (SELECT row_number() OVER () AS t, label, regexp_extract_all({FOLDED}, '{LETTERED}') AS tl FROM tp),
tw AS (SELECT t, label, len(tl) AS width, len(list_distinct(tl)) AS n, unnest(list_distinct(tl)) AS word FROM ts),
d AS (SELECT doc_id, coalesce({FOLDED}, '') AS x, regexp_extract_all(coalesce({FOLDED}, ''), '{LETTERED}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
base AS (SELECT doc_id, p - 1 AS p, label FROM p JOIN ph ON w[p : p + len(words) - 1] = words),
b AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM base GROUP BY 1),
hi AS (SELECT doc_id, t, label, width, n, p, word FROM (SELECT doc_id, p, w[p] AS word FROM p) JOIN tw USING (word)),
wi AS (SELECT doc_id, label, n, count(DISTINCT word) OVER (PARTITION BY doc_id, t ORDER BY p RANGE BETWEEN width - 1 PRECEDING AND CURRENT ROW) AS c FROM hi),
bl AS (SELECT DISTINCT doc_id, label, c, n FROM wi WHERE c * 100 >= 80 * n),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM bl) GROUP BY 1),
sc AS (SELECT doc_id, max(c / n) AS s FROM bl GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.z::BIGINT AS last_word,
  coalesce(b.l, '') AS base_labels, coalesce(al.l, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({FOLDED}, ''), '{LETTERED}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(coalesce({FOLDED}, ''), '{LETTERED}') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE: dict[str, str] = {"op2_chat_formatting": OP2, "op3_minhash_near_dedup": OP3, "op4_url_filters": OP4, "op7_license_scan": OP7, "op8_benchmark_decontamination": OP8}
