"""SQL of the queries on shared passages and near copies: plain windows and plain sets, without hashing schemes."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP2_SQL = f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS least FROM s GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM s JOIN f USING (h) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP6_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n - count(*) AS both_sets, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n),
links AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * both_sets), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(id, other) AS (SELECT DISTINCT a, a FROM ways UNION SELECT walk.id, ways.b FROM walk JOIN ways ON ways.a = walk.other),
least AS (SELECT id, min(other) AS component FROM walk GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN least ON id = doc_id"""
