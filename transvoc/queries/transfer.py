"""Vocabulary overlap and embedding transfer queries (JN-8, JN-9, JOB-4, JOB-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transvoc import oracle as O
from transvoc import testbed as tb
from transvoc.catalog import finish, register
from transvoc.operators import transfer as TR

@register("vocab_overlap", O.with_ctes(["vocab"], """
SELECT sl.lang AS src_lang, t.lang AS tgt_lang,
       CAST(count(s.token) AS BIGINT) AS n_shared,
       CAST(count(*) - count(s.token) AS BIGINT) AS n_missing
FROM vocab t CROSS JOIN (SELECT DISTINCT lang FROM vocab) sl
LEFT JOIN vocab s ON s.lang = sl.lang AND s.token = t.token
WHERE sl.lang <> t.lang
GROUP BY sl.lang, t.lang"""))
def vocab_overlap(spark, sf_dir):
    """JN-8 / JN-9: anchors (shared) and tokens to rebuild (target-only) for
    every ordered pair; an equi-join on the token, then counts."""
    v = tb.models(spark, sf_dir).vocab
    t = v.select(F.col("lang").alias("tgt_lang"), "token")
    s = v.select(F.col("lang").alias("src_lang"), "token")
    shared = (t.join(s, "token").filter(F.col("src_lang") != F.col("tgt_lang"))
              .groupBy("src_lang", "tgt_lang").agg(F.count(F.lit(1)).alias("n_shared")))
    size = v.groupBy(F.col("lang").alias("tgt_lang")).agg(F.count(F.lit(1)).alias("k"))
    langs = v.select(F.col("lang").alias("src_lang")).distinct()
    grid = size.crossJoin(F.broadcast(langs)).filter(F.col("src_lang") != F.col("tgt_lang"))
    out = grid.join(shared, ["src_lang", "tgt_lang"], "left").fillna(0, ["n_shared"])
    return finish(out.select("src_lang", "tgt_lang", F.col("n_shared").cast("long"),
                             (F.col("k") - F.col("n_shared")).cast("long").alias("n_missing")))


O.cte("pair_missing", ["vocab", "vlangs"], """
SELECT l.vocab_lang AS src_lang, t.lang AS tgt_lang, t.token, t.id AS tgt_id
FROM vocab t JOIN vlangs l ON l.vocab_lang <> t.lang
WHERE NOT EXISTS (SELECT 1 FROM vocab s WHERE s.lang = l.vocab_lang AND s.token = t.token)""")
O.cte("pair_shared", ["vocab"], """
SELECT s.lang AS src_lang, t.lang AS tgt_lang, t.token, t.id AS tgt_id, s.id AS src_id
FROM vocab t JOIN vocab s ON s.token = t.token AND s.lang <> t.lang""")

# Every missing word once per source vocabulary, cut greedily into its pieces.
O.cte("todo", ["pair_missing"], """
SELECT row_number() OVER (ORDER BY src_lang, word) AS k, src_lang, word
FROM (SELECT DISTINCT src_lang, token AS word FROM pair_missing)""")
O.cte("best_piece", ["todo", "piece_vocab"], """
SELECT k, s, max(l) AS l, arg_max(id, l) AS id FROM (
  SELECT x.k, x.s, x.l, p.id
  FROM (SELECT k, src_lang, word, s, unnest(range(1, least((SELECT max(length(token)) FROM piece_vocab),
                                                           length(word) - s + 1) + 1)) AS l
        FROM (SELECT k, src_lang, word, unnest(range(1, length(word) + 1)) AS s FROM todo)) x
  JOIN piece_vocab p ON p.lang = x.src_lang AND p.token = substring(x.word, x.s, x.l))
GROUP BY k, s""")
O.cte("walk", ["todo", "best_piece"], """
SELECT k, length(word) AS size, 1 AS nxt, []::INTEGER[] AS ids FROM todo
UNION ALL
SELECT w.k, w.size, w.nxt + coalesce(b.l, 1), list_append(w.ids, coalesce(b.id, 1))
FROM walk w LEFT JOIN best_piece b ON b.k = w.k AND b.s = w.nxt
WHERE w.nxt <= w.size""")
O.cte("token_pieces", ["walk", "todo", "pair_missing"], """
SELECT m.src_lang, m.tgt_lang, m.token, m.tgt_id, w.ids
FROM walk w JOIN todo t ON t.k = w.k JOIN pair_missing m ON m.token = t.word AND m.src_lang = t.src_lang
WHERE w.nxt > w.size""")
# Vectors: a row of `embeddings` by id, half a table further on in the source space.
O.cte("anchor_rows", ["pair_shared", "emb_n"], """
SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY src_lang, tgt_lang ORDER BY tgt_id) AS i
FROM (SELECT p.*, d.embedding::DOUBLE[] AS donor, b.embedding::DOUBLE[] AS base,
             row_number() OVER (PARTITION BY p.src_lang, p.tgt_lang, d.embedding ORDER BY p.tgt_id) AS rk
      FROM pair_shared p CROSS JOIN emb_n
      JOIN embeddings d ON d.vec_id = (p.tgt_id - 4) % emb_n.n
      JOIN embeddings b ON b.vec_id = (p.src_id - 4 + emb_n.n // 2) % emb_n.n)
WHERE rk = 1 AND list_dot_product(donor, donor) > 0""")
O.cte("omp_anchors", ["anchor_rows"], """
SELECT src_lang, tgt_lang, list(token ORDER BY i) AS names, list(src_id ORDER BY i) AS src_ids,
       list(donor ORDER BY i) AS d, list(base ORDER BY i) AS b,
       list(1 / sqrt(list_dot_product(donor, donor)) ORDER BY i) AS per_length, any_value(g) AS gram
FROM anchor_rows JOIN (
  SELECT src_lang, tgt_lang, list(row ORDER BY i) AS g FROM (
    SELECT x.src_lang, x.tgt_lang, x.i, list(list_dot_product(x.donor, y.donor) ORDER BY y.i) AS row
    FROM anchor_rows x JOIN anchor_rows y USING (src_lang, tgt_lang) GROUP BY ALL) GROUP BY ALL) USING (src_lang, tgt_lang)
GROUP BY src_lang, tgt_lang""")


def _omp_cte(k: int) -> str:
    """Every missing token rebuilt from at most ``k`` anchors: their numbers in order, coefficients, the rest's length;
    solved once for each vector that a pair's tokens have.

    A step takes the anchor whose product with the rest is largest for its length (``a`` has all of them).  ``inverse``
    is the inverse of the chosen anchors' Gram matrix; the new anchor's own part, ``s``, and its expression by the
    others, ``v``, give the next inverse and coefficients."""
    O.cte(f"omp_vectors_{k}", ["pair_missing", "omp_anchors", "emb_n"], f"""
SELECT m.src_lang, m.tgt_lang, m.vec_id,
       list_transform(a.d, lambda x: list_dot_product(x, e.embedding::DOUBLE[])) AS a,
       []::DOUBLE[][] AS inverse, []::DOUBLE[] AS coefs, []::BIGINT[] AS chosen
FROM (SELECT DISTINCT src_lang, tgt_lang, (tgt_id - 4) % emb_n.n AS vec_id FROM pair_missing CROSS JOIN emb_n) m
JOIN embeddings e USING (vec_id) LEFT JOIN omp_anchors a USING (src_lang, tgt_lang)
UNION ALL
SELECT src_lang, tgt_lang, vec_id,
       list_transform(range(1, len(a) + 1), lambda x: a[x] - t * (g[x] - CASE WHEN len(v) = 0 THEN 0.0 ELSE
         list_dot_product(v, list_transform(chosen, lambda c: gram[x][c])) END)),
       list_append(list_transform(range(1, len(v) + 1), lambda i: list_append(
         list_transform(range(1, len(v) + 1), lambda j: inverse[i][j] + v[i] * v[j] / s), -v[i] / s)),
         list_append(list_transform(v, lambda x: -x / s), 1 / s)),
       list_append(list_transform(range(1, len(v) + 1), lambda i: coefs[i] - t * v[i]), t), list_append(chosen, best)
FROM (
  SELECT *, a[best] / s AS t FROM (
    SELECT *, g[best] - CASE WHEN len(v) = 0 THEN 0.0 ELSE list_dot_product(v, by_chosen) END AS s FROM (
      SELECT *, list_transform(inverse, lambda row: list_dot_product(row, by_chosen)) AS v FROM (
        SELECT *, gram[best] AS g, list_transform(chosen, lambda c: gram[best][c]) AS by_chosen FROM (
          SELECT * EXCLUDE (scores), list_position(scores, list_max(scores)) AS best FROM (
            SELECT w.*, o.gram, list_transform(range(1, len(w.a) + 1), lambda x: round(abs(w.a[x]) * o.per_length[x], 12)) AS scores
            FROM omp_vectors_{k} w JOIN omp_anchors o USING (src_lang, tgt_lang) WHERE len(w.chosen) < {k})
          WHERE list_max(scores) > 1e-10::DOUBLE)))))""",
          "(src_lang, tgt_lang, vec_id, a, inverse, coefs, chosen) USING KEY (src_lang, tgt_lang, vec_id)")
    O.cte(f"omp_{k}", [f"omp_vectors_{k}"], f"""
SELECT m.src_lang, m.tgt_lang, m.token, m.tgt_id, v.residual, v.coefs, v.chosen
FROM pair_missing m CROSS JOIN emb_n
JOIN (SELECT v.*, sqrt(list_sum(list_transform(range(1, {tb.EMB_DIMS + 1}), lambda x: pow(
               e.embedding[x]::DOUBLE - coalesce(list_sum(list_transform(range(1, len(v.chosen) + 1),
                 lambda i: v.coefs[i] * a.d[v.chosen[i]][x])), 0.0), 2)))) AS residual
      FROM omp_vectors_{k} v JOIN embeddings e USING (vec_id) LEFT JOIN omp_anchors a USING (src_lang, tgt_lang)) v ON v.src_lang = m.src_lang AND v.tgt_lang = m.tgt_lang AND v.vec_id = (m.tgt_id - 4) % emb_n.n""")
    return f"omp_{k}"


FVT_SQL = O.with_ctes(["token_pieces", "pair_shared", "emb_n"], f"""
, pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS p, * FROM (
    SELECT src_lang, tgt_lang, token, tgt_id, 'mean' AS kind, ids FROM token_pieces
    UNION ALL
    SELECT src_lang, tgt_lang, token, tgt_id, 'copy', [src_id] FROM pair_shared)),
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
means AS (
  SELECT p, list_transform(range({tb.EMB_DIMS}), lambda d: list_avg(list_transform(list(v), lambda x: x[d + 1]))) AS mean
  FROM (SELECT p, unnest(ids) AS id FROM pieces) q CROSS JOIN emb_n
  JOIN vecs e ON e.vec_id = ((q.id - 4 + emb_n.n // 2) % emb_n.n + emb_n.n) % emb_n.n GROUP BY p)
SELECT src_lang, tgt_lang, token, CAST(tgt_id AS BIGINT) AS tgt_id, kind, CAST(len(ids) AS BIGINT) AS n_pieces,
       CAST(unnest(range({tb.EMB_DIMS})) AS BIGINT) AS dim, round(unnest(mean), 6) + 0.0::DOUBLE AS value
FROM means JOIN pieces USING (p)""", recursive=True)


@register("fvt_transfer", FVT_SQL)
def fvt_transfer(spark, sf_dir):
    """JOB-4: target embeddings of every ordered language pair: copy shared
    tokens, average the source pieces of the others."""
    m = tb.models(spark, sf_dir)
    ids = m.pieces.select("id").distinct().unionByName(
        spark.range(0, tb.N_RESERVED).select(F.col("id").cast("int")))
    emb = tb.emb_of_ids(spark, sf_dir, ids, "source")
    return finish(TR.fvt_transfer(m.vocab, m.pieces, emb))


def _omp_sql(k: int) -> str:
    return O.with_ctes([_omp_cte(k), "omp_anchors"], f"""
SELECT o.src_lang, o.tgt_lang, o.token, CAST(o.tgt_id AS BIGINT) AS tgt_id, CAST(len(o.chosen) AS BIGINT) AS n_support,
       array_to_string(list_transform(o.chosen, lambda i: a.names[i]), ',') AS support,
       round(o.residual, 6) + 0.0::DOUBLE AS residual,
       round(coalesce(list_sum(list_transform(range(1, len(o.chosen) + 1),
                                              lambda i: o.coefs[i] * list_sum(a.b[o.chosen[i]]))), 0.0), 6) + 0.0::DOUBLE AS new_sum
FROM omp_{k} o LEFT JOIN omp_anchors a USING (src_lang, tgt_lang)""", recursive=True)


@register("omp_k1", O.with_ctes([_omp_cte(1), "omp_anchors"], """
SELECT o.src_lang, o.tgt_lang, o.token, CAST(o.tgt_id AS BIGINT) AS tgt_id, a.names[o.chosen[1]] AS anchor,
       round(o.coefs[1], 6) + 0.0::DOUBLE AS coef, round(o.coefs[1] * list_sum(a.b[o.chosen[1]]), 6) + 0.0::DOUBLE AS new_sum
FROM omp_1 o JOIN omp_anchors a USING (src_lang, tgt_lang) WHERE len(o.chosen) = 1""", recursive=True))
def omp_k1(spark, sf_dir):
    """JOB-5 with k = 1: each missing target token of every pair takes the anchor
    with the largest normalised correlation (ties: lowest anchor id)."""
    anchors, missing = tb.transfer_inputs(spark, sf_dir)
    res = TR.omp(missing, anchors, 1).where(F.size("support") > 0)
    return finish(res.select("src_lang", "tgt_lang", "token", "tgt_id",
                             F.element_at("support", 1).alias("anchor"),
                             F.element_at("coefs", 1).alias("coef"),
                             F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("new_sum")))


def _omp_k(spark, sf_dir, k):
    anchors, missing = tb.transfer_inputs(spark, sf_dir)
    res = TR.omp(missing, anchors, k)
    return finish(res.select("src_lang", "tgt_lang", "token", "tgt_id", F.size("support").cast("long").alias("n_support"),
                             F.array_join("support", ",").alias("support"), "residual",
                             F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("new_sum")))


@register("omp_k8", _omp_sql(8))
def omp_k8(spark, sf_dir):
    """JOB-5 with k = 8, all pairs; the oracle takes the same steps one by one."""
    return _omp_k(spark, sf_dir, 8)


@register("omp_k64", _omp_sql(tb.OMP_K))
def omp_k64(spark, sf_dir):
    """JOB-5 with the workload's own k, all pairs; the oracle takes the same steps one by one."""
    return _omp_k(spark, sf_dir, tb.OMP_K)
