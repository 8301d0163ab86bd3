"""The queries in DuckDB's SQL, where SQL can say what they compute."""

from __future__ import annotations

from repolens.llm import licenses, linespread, mixing
from repolens.llm.common import ASCII_UPPER, SPACE_CLASS, WORD_PATTERN

KNN = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest({mixing.LEAST_WEIGHT}, 1.0 - 2.0 * CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0
           ELSE (length(text) - length(regexp_replace(text, '[#$%&*|!<>{{}}=]+', '', 'g')))::DOUBLE / length(text)::DOUBLE END) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), f AS (
  -- The first of the sources by room per weight are full; the level is that of the least number of full ones.
  SELECT *, sum(most) OVER o AS most_upto, sum(weight) OVER o AS weight_upto, most / weight AS room,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW o AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), levels AS (
  SELECT total::DOUBLE / weights::DOUBLE AS level, 0.0 AS below, (SELECT min(room) FROM f) AS above FROM f
  UNION
  SELECT (total - most_upto)::DOUBLE / (weights - weight_upto)::DOUBLE, room, lead(room) OVER (ORDER BY room, source)
  FROM f QUALIFY weights > weight_upto
), level AS (
  SELECT min(level) AS level FROM levels WHERE level >= below AND level <= above
), t AS (
  SELECT source, source_size, CASE WHEN level * weight > most THEN most::DOUBLE ELSE level * weight END AS target FROM s, level
), r AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id::VARCHAR, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM r
"""

EXACT = f"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE_CLASS}+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

LINES = f"""
WITH p AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, source, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM p
), k AS (
  SELECT *, nullif(regexp_replace(line, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g'), '') AS key
  FROM l
), spread AS (
  SELECT key, min({{'d': doc_id, 'pos': pos}}) AS first FROM k WHERE key IS NOT NULL
  GROUP BY key HAVING count(DISTINCT coalesce('1' || source, '0')) >= {linespread.MIN_SITES}
), marked AS (
  SELECT k.*, first IS NOT NULL AND {{'d': doc_id, 'pos': pos}} <> first AS gone FROM k LEFT JOIN spread USING (key)
), kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, kept.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""

def _codes() -> str:
    """Product quantisation in rounds: each compares every part with every entry."""
    start = """
WITH q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size AS (
  SELECT max(len(e)) // 16 AS w FROM q
), x AS MATERIALIZED (
  -- One row per component: p is the part, i the place in it.
  SELECT vec_id, (pos // w)::INTEGER AS p, (pos % w)::INTEGER AS i, e[pos + 1] AS v
  FROM (SELECT vec_id, e, w, unnest(range(16 * w)) AS pos FROM q, size)
), c0 AS MATERIALIZED (
  SELECT p, k, i, v FROM x
  JOIN (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS k FROM q ORDER BY vec_id LIMIT 64) USING (vec_id)
)"""
    rounds = ""
    for r in range(3):
        rounds += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, p, k, d FROM (
    SELECT vec_id, p, c.k, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d
    FROM x JOIN c{r} AS c USING (p, i) GROUP BY vec_id, p, c.k
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1
)"""
        if r < 2:
            rounds += f""", s{r} AS (
  SELECT p, k, i, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY p, k, i
), c{r + 1} AS MATERIALIZED (
  SELECT p, k, i, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{r} LEFT JOIN s{r} USING (p, k, i)
)"""
    return start + rounds + """, coded AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, k, i)) FROM c2) AS codebooks_sha256
FROM coded JOIN q USING (vec_id)
"""


FOREST = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '{WORD_PATTERN}') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w
), keyed AS MATERIALIZED (
  SELECT doc_id, sh, len(sh) AS n, sha256(array_to_string(list_sort(sh), chr(10))) AS key FROM s
), k AS MATERIALIZED (
  SELECT key, min(doc_id) AS node, any_value(sh) AS sh, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY key
), u AS MATERIALIZED (
  SELECT node, n, unnest(sh) AS g FROM k
), e AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM u AS a JOIN u AS b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT node, node AS root FROM k
  UNION
  SELECT e2.b, r.root FROM reach AS r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) AS e2 ON r.node = e2.a
), roots AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT doc_id, keyed.n::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM keyed LEFT JOIN k USING (key) LEFT JOIN roots ON roots.node = k.node
"""

ORACLES = {
    "op4_license_scan": licenses.ORACLE_SQL, "op5_voronoi_knn": KNN, "op6_mix_sources": MIX,
    "op9_exact_dedup": EXACT, "op10_line_dedup": LINES,
    "op11_ball_kmeans_codes": _codes(), "op12_lsh_forest": FOREST,
}
