"""DuckDB SQL for the operators' queries, where SQL can express them."""

from skyloom.llm.suffix_dedup import PASSAGE, PHRASE_BITS, TRIGGER, TRIGGER_MULTIPLIER

_WORD = " || ".join(f"h[{i}:{i + 1}]" for i in range(2 * TRIGGER - 1, 0, -2))
"""Eight bytes in hexadecimal, the last first."""

ORACLES = {
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (
  SELECT doc_id, p, n, word,
         CASE WHEN p + 19 <= n THEN
           md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ')) END AS k
  FROM w),
dup AS (
  SELECT *, CASE WHEN k IS NULL THEN 0
                 WHEN row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS d
  FROM win),
cov AS (
  SELECT doc_id, p, word, max(d) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM dup),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept
  FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
""",
    "op6_suffix_dedup": rf"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, s, md5(b[s:s + 399]) AS k
        FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS s FROM b WHERE octet_length(b) >= 400)),
hit AS (SELECT doc_id, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
run AS (SELECT doc_id, s, CASE WHEN s <= 400 + lag(s) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS new FROM hit),
span AS (SELECT doc_id, min(s) AS a, max(s) + 399 AS z
         FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM run) GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, b.b[coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 : a - 1] AS kept, z - a + 1 AS n
          FROM span JOIN b USING (doc_id)),
agg AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_spans, string_agg(hex(kept), '' ORDER BY a) AS kept FROM piece GROUP BY doc_id),
tail AS (SELECT doc_id, max(z) AS z FROM span GROUP BY doc_id),
octet AS (SELECT doc_id, s, hex(b[s:s + {TRIGGER - 1}]) AS h
          FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {TRIGGER - 2})) AS s FROM b WHERE octet_length(b) >= {TRIGGER})),
trig AS (SELECT doc_id, s FROM octet
         WHERE (('0x' || {_WORD})::UBIGINT::UHUGEINT * {TRIGGER_MULTIPLIER}::UHUGEINT) % {1 << 64}::UHUGEINT < {1 << 64 - PHRASE_BITS}::UHUGEINT),
phrases AS (SELECT x.doc_id, x.s, y.s + {TRIGGER} AS z FROM trig x ASOF JOIN trig y ON x.doc_id = y.doc_id AND x.s + {PASSAGE - TRIGGER} <= y.s),
keyed AS (SELECT doc_id, s, z, md5(b.b[s:z - 1]) AS k FROM phrases JOIN b USING (doc_id)),
again AS (SELECT doc_id, s, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY s), s) AS before
          FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
short AS (SELECT doc_id, sum(z - greatest(s, before)) AS n_repeated FROM again GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b.b[coalesce(z, 0) + 1 : octet_length(b.b)]))) AS kept_sha256,
       coalesce(n_repeated, 0)::BIGINT AS n_repeated
FROM b LEFT JOIN agg USING (doc_id) LEFT JOIN tail USING (doc_id) LEFT JOIN short USING (doc_id)
""",
    "op7_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
