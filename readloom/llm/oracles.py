"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM w, range(1, 100000) t(i) WHERE len(ws) >= 5 AND i <= len(ws) - 4
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') AS g FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM two UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) >= 0.9 * a.norm * b.norm),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM two UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a),
c AS (SELECT v.vec_id, CAST((SELECT count(*) FROM two WHERE a = v.vec_id) AS BIGINT) AS n_links, least(v.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = v.vec_id), v.vec_id)) AS component_id FROM v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c
"""

_BITS = "array_to_string(list_transform(string_split(sha1(p), ''), lambda c: substring('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (instr('0123456789abcdef', c) - 1) + 1 AS INT), 4)), '')"
_FIVE = " + ".join(f"{16 >> k} * CAST(substring(bits, CAST(5 * i + {k + 1} AS INT), 1) AS INT)" for k in range(5))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
b AS (SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, {_BITS} AS bits FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_FIVE} + 1 AS INT), 1)), '') AS payload_digest FROM b),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to FROM m
"""

ORACLES = {"op1_ngram_jaccard_join": NGRAM_JOIN, "op6_embedding_near_dedup": NEAR_VECTORS, "op10_warc": WARC}
