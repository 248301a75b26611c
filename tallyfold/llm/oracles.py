"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM g) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r
), l AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)
), r AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other
), k AS (
  SELECT x, count(*) AS n_links FROM l GROUP BY x
)
SELECT c.doc_id, c.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id) c LEFT JOIN k ON k.x = c.doc_id
"""


OP12 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]'), lambda y: y <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM t)
), g AS MATERIALIZED (
  SELECT lang, k, s, count(*) AS f
  FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
    FROM p, generate_series(1, 5) AS x(k) WHERE len(w) >= k)
  GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, s, f AS a FROM g WHERE k >= 2 AND f >= 100
), gone AS (
  SELECT DISTINCT c.lang, c.s
  FROM c JOIN c d ON c.lang = d.lang AND d.k > c.k AND contains(' ' || d.s || ' ', ' ' || c.s || ' ') AND 100 * d.a >= 100 * c.a
), cuts AS (
  SELECT lang, s, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM (SELECT lang, k, s, a, string_split(s, ' ') AS w, unnest(range(1, k)) AS j FROM c ANTI JOIN gone USING (lang, s))
), scored AS (
  SELECT u.lang, u.s, u.a, l.f AS l, r.f AS r, n.n, j,
    (1000 * CAST(u.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM cuts u JOIN g l ON l.lang = u.lang AND l.s = u.x JOIN g r ON r.lang = u.lang AND r.s = u.y JOIN n ON n.lang = u.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest
QUALIFY rank <= 2000
"""


def op13(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds by plain distances, one pair of tables a round."""
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS j, e
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT i, min(struct_pack(d := d, j := j)) AS m
  FROM (
    SELECT v.i, c.j,
      CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v CROSS JOIN c{r} c)
  GROUP BY i
)""")
        if r < rounds:
            parts.append(f"""
s{r} AS MATERIALIZED (
  SELECT j, list(CAST(x AS BIGINT) ORDER BY t) AS e
  FROM (
    SELECT j, t, (s - ((s % n) + n) % n) // n AS x
    FROM (
      SELECT m.j AS j, t, sum(e[t]) AS s, count(*) AS n
      FROM a{r} JOIN v USING (i), generate_series(1, 64) g(t) GROUP BY 1, 2))
  GROUP BY j
), c{r + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(s.e, c.e) AS e FROM c{r} c LEFT JOIN s{r} s USING (j)
)""")
    return "WITH " + ",".join(parts) + f"""
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance,
  CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} c ON c.j = m.j
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": OP2, "op7_top_k": OP7, "op9_jaccard": OP9, "op12_collocations": OP12, "op13_centroids": op13()}
