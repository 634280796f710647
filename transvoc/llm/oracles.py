"""DuckDB equivalents of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

NEAR_DEDUP = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, {WORDS} AS w FROM docs),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                                lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, least(a, min(b)) AS component FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component, d.doc_id) AS component_id,
       coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_id l ON l.a = d.doc_id
"""


def _spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {number} AS kind_no, m, secret,
         list_sum(list_transform(before[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(
           matches[1:i - 1], lambda x: length(x))), 0) AS first_at
  FROM (SELECT doc_id, before, matches, unnest(matches) AS m, unnest(secrets) AS secret,
               generate_subscripts(matches, 1) AS i
        FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS before,
                     regexp_extract_all(text, '{pattern}') AS matches,
                     regexp_extract_all(text, '{pattern}', {group}) AS secrets
              FROM documents WHERE regexp_matches(text, '{pattern}')))
  WHERE length(secret) >= {least}"""


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = f"""
WITH found AS ({_spans('assign', 1, ASSIGN, 2, 8)}
  UNION ALL {_spans('access', 2, 'AKIA[A-Z0-9]+', 0, 16)}
  UNION ALL {_spans('hex', 3, '[0-9a-f]+', 0, 32)}),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || first_at::BIGINT || ':' || (first_at + length(m))::BIGINT, ','
                    ORDER BY first_at, kind_no) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans, sha256(coalesce(text, '')) AS blob
FROM documents d LEFT JOIN joined USING (doc_id)
"""


def _round(number: int) -> str:
    """Assigned vectors and new centroids of one round."""
    return f"""
apart{number} AS (
  SELECT v.row_no, v.vec_id, v.x, c.cluster,
         list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS distance
  FROM vectors v, centroids{number} c),
near{number} AS (
  SELECT row_no, vec_id, x, min({{'distance': distance, 'cluster': cluster}}) AS best FROM apart{number} GROUP BY ALL),
sums{number} AS (
  SELECT best.cluster AS cluster, i, count(*)::BIGINT AS n, sum(x[i])::BIGINT AS s
  FROM near{number}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
means{number} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums{number} GROUP BY cluster),
centroids{number + 1} AS (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM centroids{number} c LEFT JOIN means{number} m USING (cluster))"""


CENTROIDS = f"""
WITH vectors AS (
  SELECT row_number() OVER () AS row_no, vec_id,
         list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, x FROM vectors
  ORDER BY sha256('1:' || vec_id) LIMIT 16),
{",".join(map(_round, range(4)))},
inertias AS (SELECT best.cluster AS cluster, sum(best.distance)::BIGINT AS s FROM near3 GROUP BY 1)
SELECT a.vec_id, a.best.cluster::INTEGER AS cluster, a.best.distance AS distance, t.s AS cluster_inertia,
       (SELECT sum(s)::BIGINT FROM inertias) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda e: e::VARCHAR), ',')) AS centroid_sha256
FROM near3 a JOIN inertias t ON t.cluster = a.best.cluster JOIN centroids3 c ON c.cluster = a.best.cluster
"""

LEXICAL = r"""
WITH doc_terms AS (
  SELECT doc_id, row_no, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_no, * FROM documents)),
item_terms AS (
  SELECT item_id, row_no, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_no, * FROM benchmark)),
sizes AS (SELECT row_no, count(*) AS n FROM doc_terms GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
tf AS (SELECT doc_id, row_no, term, count(*) AS tf FROM doc_terms SEMI JOIN item_terms USING (term) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY term, docs),
scores AS (
  SELECT i.item_id, i.row_no AS item_no, tf.doc_id, tf.row_no,
         sum(w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms i JOIN tf USING (term) JOIN weights USING (term) JOIN sizes s ON s.row_no = tf.row_no, totals
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {"op13_lexical_search": LEXICAL, "op11_centroids": CENTROIDS, "op4_near_dedup": NEAR_DEDUP, "op5_secret_scan": SECRETS}
