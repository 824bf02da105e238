"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"

OP3 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
s AS (SELECT *, regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM l),
k AS (SELECT doc_id, line, pos, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, g.key IS NOT NULL AND k.doc_id < g.last AS drop
      FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.q, v.q)::BIGINT AS score
      FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

#: ``crc`` folds the checksum's table over the bytes of ``<doc_id>:<run>``; near
#: words meet in the keys that a word has with one code point taken out.
OP13 = """
WITH RECURSIVE bits AS (
    SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256)
    UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(
             list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INTEGER, 2))::BIGINT),
             lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295::BIGINT)) AS h FROM b, t),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER)
                  || substr(run, (h % length(run) + 2)::INTEGER) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, pos, substr(word, 1, (pos - 1)::INTEGER) AS head, substr(word, (pos + 1)::INTEGER) AS tail
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM k AS a JOIN k AS b USING (head, tail) WHERE a.word <> b.word
      UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.head || k.tail
      UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.head || k.tail),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n
      FROM e GROUP BY word),
g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
             CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM w LEFT JOIN f USING (word)),
u AS (SELECT word, word AS root, form AS next FROM g
      UNION ALL SELECT u.word, g.word, g.form FROM u JOIN g ON u.next = g.word)
SELECT word, form, u.root, n, n_near, form_n FROM g JOIN u USING (word) WHERE u.next IS NULL
"""

SQL: dict[str, str] = {"op3_line_dedup": OP3, "op11_shared_list_negatives": OP11, "op13_spelling_variants": OP13}
