"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: All pairs of distinct texts with n-gram similarity of at least 0.8, by an inverted index instead of MinHash; then components.
_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
reps AS (SELECT text, min(doc_id) AS least, count(*) AS n, row_number() OVER (ORDER BY text) AS rep FROM d GROUP BY text),
w AS (SELECT rep, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM reps),
g AS (SELECT rep, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS gram FROM w),
s AS (SELECT DISTINCT rep, gram FROM g),
k AS (SELECT rep, count(*) AS k FROM s GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT x, y FROM p JOIN k kx ON kx.rep = x JOIN k ky ON ky.rep = y WHERE c / (kx.k + ky.k - c) >= 0.8),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT d.doc_id, least(least, (SELECT min(o.least) FROM r JOIN reps o ON o.rep = r.y WHERE r.x = reps.rep)) AS class_id, n - 1 AS copies,
       (SELECT count(*) FROM b WHERE b.x = rep) AS links
FROM d JOIN reps USING (text)
"""

_MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) AS e,
         length(coalesce(text, '')) AS n,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '*&$%#|<>{}=', '')) AS junk
  FROM documents),
q AS (SELECT doc_id, source, size, e / CASE WHEN n > 0 THEN greatest(0.05, 1.0 - 4.0 * junk / n) ELSE 1.0 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
t AS (SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
fill(k, level) AS (
  SELECT 0, 1.5 * (SELECT sum(source_size) FROM t) / (SELECT sum(w) FROM t)
  UNION ALL
  SELECT k + 1, (1.5 * (SELECT sum(source_size) FROM t) - (SELECT coalesce(sum(cap), 0) FROM t WHERE cap < level * w)) / (SELECT sum(w) FROM t WHERE cap >= level * w)
  FROM fill WHERE k < 40 AND EXISTS (SELECT 1 FROM t WHERE cap >= level * w)),
goal AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM fill)) AS target FROM t),
b AS (SELECT *, floor(target / source_size) AS epochs, target - floor(target / source_size) * source_size AS budget FROM goal),
o AS (SELECT q.*, source_size, target, epochs::BIGINT AS epochs, budget, sum(size) OVER (PARTITION BY q.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source),
z AS (SELECT *, CASE WHEN budget > 0 AND (upto <= budget OR (upto - size < budget AND upto - budget <= budget - upto + size)) THEN 1 ELSE 0 END AS picked FROM o)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + picked) AS BIGINT) AS taken, epochs, picked FROM z
"""

_REPEATS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM n WHERE n >= 100)),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM w),
c AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS new FROM g WHERE r > 1),
i AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM c),
o AS (SELECT doc_id, k, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY doc_id, k),
x AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prior FROM o),
y AS (SELECT x.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM x JOIN n ON n.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN y ON y.doc_id = n.doc_id
"""

_TOP = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _NEAR,
    "op6_source_mix": _MIX,
    "op8_suffix_dedup": _REPEATS,
    "op9_kd_top_k": _TOP,
}
