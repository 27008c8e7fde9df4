"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS q FROM w),
wins AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + 13], ' ') AS body
         FROM (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS p FROM w WHERE len(ws) >= 13)),
least AS (SELECT body, min(doc_id) AS least FROM wins GROUP BY body),
gone AS (SELECT DISTINCT doc_id, q FROM
         (SELECT wins.doc_id, unnest(range(p, p + 13)) AS q FROM wins JOIN least USING (body) WHERE wins.doc_id > least)),
kept AS (SELECT words.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY words.q) AS body
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q
         WHERE gone.q IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

DECONTAMINATE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_TERM}) AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS l,
               array_to_string(ws[s + 1:s + least(len(ws), 13)], ' ') AS body
        FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 13, 0) + 1)) AS s FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, p, l, array_to_string(ws[p + 1:p + l], ' ') AS body
       FROM (SELECT doc_id, ws, l, unnest(range(len(ws) - l + 1)) AS p
             FROM w, (SELECT DISTINCT l FROM win) WHERE len(ws) >= l)),
m AS (SELECT doc_id, p, dw.l, item_id FROM dw JOIN win USING (l, body)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, body FROM
       (SELECT doc_id, array_to_string(ws[p + 1:p + 5], ' ') AS body
        FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 5, 0) + 1)) AS p FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b USING (body)
      WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * common >= 75 * (na.n + nb.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY x) m USING (doc_id)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
