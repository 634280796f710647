"""Report queries over the metrics table (SRC-8, SNK-3, SET-1, JN-4, PRJ-3/4,
FLT-2..6, AGG-8..14, SRT-1..4, JOB-11, JOB-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transvoc import oracle as O
from transvoc import testbed as tb
from transvoc.catalog import finish, register
from transvoc.operators import report as R
from transvoc.queries import evaluation, transfer  # noqa: F401 - their CTEs
from transvoc.session import scratch_path
from transvoc.sources import metrics_json as MJ

T = tb.GATE
M13 = R.METRICS
EVALUATED = "coalesce(" + ", ".join(M13) + ") IS NOT NULL"
ALLOWED = ("method IN (" + ", ".join(f"'{m}'" for m in R.REPORT_METHODS) + ") AND NOT ("
           + " OR ".join(f"(regime = '{r}' AND method IN ({', '.join(repr(m) for m in ms)}))"
                         for r, ms in R.DEFAULT_EXCLUDED.items()) + ")")


def _ok(side: str, t: float) -> str:
    return f"coalesce({side}_uid_prop, 1.0) < {t}"


def _pair_ok(t: float) -> str:
    return f"({_ok('src', t)} AND {_ok('tgt', t)})"


def _label_sql(m: str = "method", r: str = "regime") -> str:
    mm = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.METHOD_DISPLAY.items())
    rr = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.REGIME_DISPLAY.items())
    return f"(CASE {m} {mm} ELSE {m} END) || ' (' || (CASE {r} {rr} ELSE {r} END) || ')'"


def _ord_sql(m: str = "method", r: str = "regime") -> str:
    mm = " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(R.REPORT_METHODS))
    rr = " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(R.REGIMES))
    return f"(CASE {r} {rr} ELSE 99 END) * 10 + (CASE {m} {mm} ELSE 9 END)"


SKELETON = "skel AS (SELECT regime, method, {label} AS label, {ord} AS ord FROM (VALUES {rows}) s(regime, method))".format(
    label=_label_sql(), ord=_ord_sql(),
    rows=", ".join(f"('{r}', '{m}')" for r in R.REGIMES for m in R.REPORT_METHODS
                   if m not in R.DEFAULT_EXCLUDED.get(r, [])))
CELLS = f"cells AS (SELECT * FROM metrics WHERE {ALLOWED} AND {EVALUATED})"


def _r6(x: str) -> str:
    return f"round({x}, 6)"


# ---------------------------------------------------------------- the metric matrix, from its definition

# Weights of the transferred models: shared tokens, all pieces, all anchors, and the two ids that stand for themselves.
O.cte("tweights", ["pair_shared", "token_pieces", f"omp_{tb.OMP_K}", "omp_anchors", "vlangs"], f"""
SELECT src_lang, tgt_lang, method, tgt_id AS id, src_id AS sid, 1.0::DOUBLE AS w
FROM pair_shared CROSS JOIN (VALUES ('fvt'), ('omp')) x(method)
UNION ALL
SELECT src_lang, tgt_lang, 'fvt', tgt_id, sid, count(*) / any_value(k)::DOUBLE
FROM (SELECT src_lang, tgt_lang, tgt_id, len(ids) AS k, unnest(ids) AS sid FROM token_pieces) GROUP BY src_lang, tgt_lang, tgt_id, sid
UNION ALL
SELECT src_lang, tgt_lang, 'omp', tgt_id, src_ids[c], w FROM (
  SELECT o.src_lang, o.tgt_lang, o.tgt_id, a.src_ids, unnest(o.chosen) AS c, unnest(o.coefs) AS w
  FROM omp_{tb.OMP_K} o JOIN omp_anchors a USING (src_lang, tgt_lang))
UNION ALL
SELECT s.vocab_lang, t.vocab_lang, method, id, id, 1.0 FROM vlangs s JOIN vlangs t ON s.vocab_lang <> t.vocab_lang
CROSS JOIN (VALUES ('fvt'), ('omp')) x(method) CROSS JOIN (VALUES (1), (2)) y(id)""")
O.cte("plan_models", ["vlangs"], """
SELECT *, vocab_lang || '|' || array_to_string(parts, '+') AS model FROM (
  SELECT regime, s.vocab_lang AS src_lang, t.vocab_lang AS tgt_lang, label,
         CASE label WHEN '100mb_src' THEN s.vocab_lang ELSE t.vocab_lang END AS vocab_lang,
         list_concat([CASE label WHEN '100mb_src' THEN s.vocab_lang WHEN '10mb_tgt' THEN t.vocab_lang
                      ELSE label || ':' || s.vocab_lang END],
                     CASE WHEN label = '10mb_tgt' OR regime = 'no-finetuning' THEN []::VARCHAR[]
                          WHEN regime = 'mono-finetuning' THEN [t.vocab_lang] ELSE [s.vocab_lang, t.vocab_lang] END) AS parts
  FROM vlangs s JOIN vlangs t ON s.vocab_lang <> t.vocab_lang
  CROSS JOIN (VALUES ('no-finetuning'), ('mono-finetuning'), ('mixed-finetuning')) r(regime)
  CROSS JOIN (VALUES ('100mb_src'), ('10mb_tgt'), ('fvt'), ('omp')) x(label))""")
# Held-out words and the same in reverse order, under every vocabulary.
O.cte("side_tokens", ["min_pairs"], f"""
SELECT lang, doc_id, line_no, side, unnest(ws) AS token, unnest(range(len(ws))) AS pos
FROM (SELECT lang, doc_id, line_no, 0 AS side, {O.words('sen')} AS ws FROM min_pairs
      UNION ALL SELECT lang, doc_id, line_no, 1, {O.words('wrong_sen')} FROM min_pairs)""")
O.cte("side_labels", ["side_tokens", "vocab", "vlangs"], """
SELECT *, coalesce(lag(tok) OVER (PARTITION BY vocab_lang, lang, doc_id, line_no, side ORDER BY pos), 2) AS prev
FROM (SELECT l.vocab_lang, t.lang, t.doc_id, t.line_no, t.side, t.pos, coalesce(v.id, 1) AS tok
      FROM side_tokens t CROSS JOIN vlangs l LEFT JOIN vocab v ON v.lang = l.vocab_lang AND v.token = t.token)""")
O.cte("needed", ["side_labels"], "SELECT DISTINCT vocab_lang, prev, tok FROM side_labels")
# Counts of every part: a language's text under a vocabulary, or a transferred model (W C W').
O.cte("text_counts", ["pool_tokens", "vocab", "vlangs"], """
SELECT vocab_lang, lang, prev, tok, count(*) AS n FROM (
  SELECT *, coalesce(lag(tok) OVER (PARTITION BY vocab_lang, lang, doc_id, line_no ORDER BY pos), 2) AS prev
  FROM (SELECT l.vocab_lang, t.lang, t.doc_id, t.line_no, t.pos, coalesce(v.id, 1) AS tok
        FROM pool_tokens t CROSS JOIN vlangs l LEFT JOIN vocab v ON v.lang = l.vocab_lang AND v.token = t.token))
GROUP BY ALL""")
O.cte("moved_rows", ["tweights", "lm", "needed"], """
SELECT p.src_lang, p.tgt_lang, p.method, p.id AS prev, c.tok AS b, sum(p.w * c.n) AS x
FROM (SELECT w.* FROM tweights w SEMI JOIN needed n ON n.vocab_lang = w.tgt_lang AND n.prev = w.id) p
JOIN lm c ON c.lang = p.src_lang AND c.prev = p.sid
SEMI JOIN (SELECT DISTINCT src_lang, tgt_lang, method, sid FROM tweights) s
  ON s.src_lang = p.src_lang AND s.tgt_lang = p.tgt_lang AND s.method = p.method AND s.sid = c.tok
GROUP BY ALL""")
O.cte("moved_contexts", ["tweights", "lm_ctx"], """
SELECT w.src_lang, w.tgt_lang, w.method, w.id AS prev, greatest(0.0, sum(w.w * c.n_prev)) AS n
FROM tweights w JOIN lm_ctx c ON c.lang = w.src_lang AND c.prev = w.sid GROUP BY ALL""")
O.cte("moved_counts", ["moved_rows", "moved_contexts", "tweights", "needed"], """
SELECT m.*, n.n AS context FROM (
  SELECT w.src_lang, w.tgt_lang, w.method, d.prev, d.tok, sum(w.w * r.x) AS c
  FROM needed d JOIN tweights w ON w.tgt_lang = d.vocab_lang AND w.id = d.tok
  JOIN moved_rows r ON r.src_lang = w.src_lang AND r.tgt_lang = w.tgt_lang AND r.method = w.method AND r.prev = d.prev AND r.b = w.sid
  GROUP BY ALL) m JOIN moved_contexts n USING (src_lang, tgt_lang, method, prev)""")
O.cte("parts", ["moved_counts", "text_counts"], """
SELECT vocab_lang, lang AS part, prev, tok, n::DOUBLE AS c FROM text_counts
UNION ALL
SELECT tgt_lang, method || ':' || src_lang, prev, tok, least(greatest(c, 0.0), context) FROM moved_counts""")
O.cte("part_contexts", ["text_counts", "moved_contexts"], """
SELECT vocab_lang, lang AS part, prev, sum(n)::DOUBLE AS n FROM text_counts GROUP BY ALL
UNION ALL
SELECT tgt_lang, method || ':' || src_lang, prev, n FROM moved_contexts""")
O.cte("model_parts", ["plan_models"], """
SELECT model, vocab_lang, unnest(parts) AS part FROM (SELECT DISTINCT model, vocab_lang, parts FROM plan_models)""")
O.cte("model_losses", ["plan_models", "model_parts", "parts", "part_contexts", "side_labels"], f"""
SELECT s.*, CAST(round(-ln((coalesce(c.c, 0.0) + {tb.ALPHA}) / (coalesce(n.n, 0.0) + {tb.ALPHA} * {tb.VOCAB_SIZE})) * 1e12) AS BIGINT) AS q
FROM (SELECT DISTINCT m.model, l.vocab_lang, l.lang, l.prev, l.tok FROM side_labels l
      JOIN (SELECT DISTINCT model, vocab_lang, unnest([src_lang, tgt_lang]) AS lang FROM plan_models) m USING (vocab_lang, lang)) s
LEFT JOIN (SELECT model, prev, tok, sum(c) AS c FROM parts JOIN model_parts USING (vocab_lang, part) GROUP BY ALL) c
  ON c.model = s.model AND c.prev = s.prev AND c.tok = s.tok
LEFT JOIN (SELECT model, prev, sum(n) AS n FROM part_contexts JOIN model_parts USING (vocab_lang, part) GROUP BY ALL) n
  ON n.model = s.model AND n.prev = s.prev""")
O.cte("model_lines", ["model_losses", "side_labels", "dev_info"], f"""
SELECT q.model, l.lang, l.doc_id, l.line_no, any_value(i.nbytes) AS nbytes,
       sum(CASE WHEN side = 0 AND pos >= i.h AND pos < {tb.MAX_SEQ_LEN - 1}
                THEN CASE WHEN l.tok = 1 THEN log2({tb.VOCAB_SIZE}) ELSE q / 1e12 / ln(2) END ELSE 0.0 END) AS surprisal,
       count(*) FILTER (WHERE side = 0 AND pos < {tb.MAX_SEQ_LEN - 1} AND l.tok = 1) AS n_unk,
       count(*) FILTER (WHERE side = 0 AND pos < {tb.MAX_SEQ_LEN - 1}) AS n_read,
       sum(CASE WHEN side = 1 THEN q ELSE -q END) AS delta, count(*) FILTER (WHERE side = 0) >= {tb.MIN_PAIR_MAX_LEN} AS over
FROM side_labels l JOIN model_losses q ON q.vocab_lang = l.vocab_lang AND q.lang = l.lang AND q.prev = l.prev AND q.tok = l.tok
JOIN dev_info i ON i.lang = l.lang AND i.doc_id = l.doc_id AND i.line_no = l.line_no
GROUP BY q.model, l.lang, l.doc_id, l.line_no""")
O.cte("matrix", ["model_lines", "plan_models", "compression"], """
WITH m AS (SELECT model, lang, avg(surprisal) AS log_ppl, avg(surprisal / nbytes) AS norm_ppl, avg(n_unk / n_read) AS uid,
                  avg(CASE WHEN NOT over AND delta > 0 THEN 1.0 ELSE 0.0 END) AS mbp FROM model_lines GROUP BY model, lang)
SELECT p.regime, p.src_lang, p.tgt_lang, p.label, a.log_ppl AS src_log_ppl, b.log_ppl AS tgt_log_ppl,
       a.log_ppl + b.log_ppl AS sum_log_ppl, a.norm_ppl AS src_norm_ppl, b.norm_ppl AS tgt_norm_ppl,
       a.norm_ppl + b.norm_ppl AS sum_norm_ppl, b.uid AS tgt_uid_prop, a.uid AS src_uid_prop, x.bpt AS src_bpt, y.bpt AS tgt_bpt,
       a.mbp AS src_mbp, b.mbp AS tgt_mbp, a.mbp + b.mbp AS sum_mbp
FROM plan_models p JOIN m a ON a.model = p.model AND a.lang = p.src_lang JOIN m b ON b.model = p.model AND b.lang = p.tgt_lang
JOIN compression x ON x.vocab_lang = p.vocab_lang AND x.lang = p.src_lang
JOIN compression y ON y.vocab_lang = p.vocab_lang AND y.lang = p.tgt_lang""")
# What the reports read: the matrix, and empty cells for the labels that are never evaluated.
O.cte("metrics", ["matrix"], f"""
SELECT * RENAME (label AS method) FROM matrix
UNION ALL BY NAME
SELECT DISTINCT regime, src_lang, tgt_lang, m AS method FROM matrix CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in tb.NOT_EVALUATED)}) x(m)""")


@register("pair_metrics", O.with_ctes(["matrix"], f"""
SELECT regime, src_lang, tgt_lang, label, {", ".join(f"{_r6(m)} AS {m}" for m in M13)} FROM matrix""", recursive=True))
def pair_metrics(spark, sf_dir):
    """JOB-11 / JN-4 / PRJ-3: the 13 metrics of every ordered pair, label and regime: source and target baseline and
    the source model carried over by FVT and by OMP, untuned and tuned on the pair's text."""
    return finish(tb.written_matrix(spark, sf_dir))


# ---------------------------------------------------------------- metrics documents

@register("metrics_flatten", O.with_ctes(["metrics"], recursive=True, select=f"""
SELECT regime, src_lang, tgt_lang, method, {", ".join(f"{_r6(m)} AS {m}" for m in M13)}
FROM metrics WHERE {EVALUATED}"""))
def metrics_flatten(spark, sf_dir):
    """SNK-3 -> SRC-8 -> SET-1 -> FLT-6: one nested JSON document per regime
    written, read back per regime, labelled, unioned, flattened, and the
    not-evaluated cells dropped."""
    path = scratch_path(spark, "metrics_docs")
    MJ.write_metrics(MJ.to_documents(MJ.nest_metrics(tb.metrics(spark, sf_dir))), path)
    back = MJ.read_metrics(spark, {r: f"{path}/regime={r}" for r in R.REGIMES})
    return finish(back.filter(R.is_evaluated()))


@register("metrics_nest", O.with_ctes(["metrics"], recursive=True, select=f"""
SELECT regime, src_lang, tgt_lang, method,
       CAST(CASE WHEN {EVALUATED} THEN 1 ELSE 0 END AS BIGINT) AS evaluated,
       round(sum_norm_ppl, 6) AS sum_norm_ppl
FROM metrics"""))
def metrics_nest(spark, sf_dir):
    """SNK-3 / FN-8: nest into per-regime maps, serialise, parse and explode
    back; every cell, evaluated or not, survives the round trip."""
    docs = MJ.to_documents(MJ.nest_metrics(tb.metrics(spark, sf_dir)))
    parsed = docs.select("regime", F.from_json("json", MJ.NESTED).alias("doc"))
    flat = MJ.flatten(parsed)
    return finish(flat.select("regime", "src_lang", "tgt_lang", "method",
                              R.is_evaluated().cast("long").alias("evaluated"), "sum_norm_ppl"))


# ---------------------------------------------------------------- gates and selection

@register("quality_gates", O.with_ctes(["metrics"], recursive=True, select=f"""
SELECT regime, src_lang, tgt_lang, method,
       CAST(CASE WHEN {_ok('src', T)} THEN 1 ELSE 0 END AS BIGINT) AS src_ok,
       CAST(CASE WHEN {_ok('tgt', T)} THEN 1 ELSE 0 END AS BIGINT) AS tgt_ok,
       CAST(CASE WHEN {_pair_ok(T)} THEN 1 ELSE 0 END AS BIGINT) AS pair_ok,
       CAST(CASE WHEN {_pair_ok(R.DEFAULT_THRESHOLD)} THEN 1 ELSE 0 END AS BIGINT) AS pair_ok_default
FROM metrics"""))
def quality_gates(spark, sf_dir):
    """FLT-2..4 / FN-11: unknown-share gates (strict, missing = 1)."""
    m = tb.metrics(spark, sf_dir)
    return finish(m.select("regime", "src_lang", "tgt_lang", "method",
                           R.src_ok(T).cast("long").alias("src_ok"),
                           R.tgt_ok(T).cast("long").alias("tgt_ok"),
                           R.pair_ok(T).cast("long").alias("pair_ok"),
                           R.pair_ok(R.DEFAULT_THRESHOLD).cast("long").alias("pair_ok_default")))


@register("method_selection", O.with_ctes(["metrics"], recursive=True, select=f"""
SELECT regime, src_lang, tgt_lang, method,
       CAST(CASE WHEN {EVALUATED} THEN 1 ELSE 0 END AS BIGINT) AS evaluated
FROM metrics WHERE {ALLOWED}"""))
def method_selection(spark, sf_dir):
    """FLT-5: allowed methods minus the per-regime exclusions."""
    s = R.select_methods(tb.metrics(spark, sf_dir))
    return finish(s.select("regime", "src_lang", "tgt_lang", "method",
                           R.is_evaluated().cast("long").alias("evaluated")))


# ---------------------------------------------------------------- tables

TARGET_SQL = O.with_ctes(["metrics"], recursive=True, select=f"""
, {SKELETON}, {CELLS},
st AS (
  SELECT regime, method,
         median(CASE WHEN {_ok('tgt', T)} THEN tgt_norm_ppl END) AS a1,
         stddev_pop(CASE WHEN {_ok('tgt', T)} THEN tgt_norm_ppl END) AS a2,
         median(CASE WHEN {_ok('tgt', T)} THEN tgt_mbp END) AS a3,
         stddev_pop(CASE WHEN {_ok('tgt', T)} THEN tgt_mbp END) AS a4,
         avg(CASE WHEN {_ok('tgt', T)} THEN tgt_bpt END) AS a5,
         count(CASE WHEN {_ok('tgt', T)} THEN tgt_norm_ppl END) AS a6
  FROM cells GROUP BY regime, method),
tgt_table AS (
  SELECT s.regime, s.method, s.label, s.ord, a1 AS tgt_norm_ppl_median, a2 AS tgt_norm_ppl_std,
         a3 AS tgt_mbp_median, a4 AS tgt_mbp_std, a5 AS bytes_per_token, a6 AS n_cells
  FROM skel s LEFT JOIN st ON st.regime = s.regime AND st.method = s.method)""")


@register("report_target", TARGET_SQL + """
SELECT regime, method, label, CAST(ord AS BIGINT) AS ord,
       round(tgt_norm_ppl_median, 6) AS tgt_norm_ppl_median, round(tgt_norm_ppl_std, 6) AS tgt_norm_ppl_std,
       round(tgt_mbp_median, 6) AS tgt_mbp_median, round(tgt_mbp_std, 6) AS tgt_mbp_std,
       round(bytes_per_token, 6) AS bytes_per_token, CAST(n_cells AS BIGINT) AS n_cells
FROM tgt_table""")
def report_target(spark, sf_dir):
    """AGG-8 / AGG-14 / PRJ-4: target-side table per regime x method."""
    return finish(R.report_target(tb.metrics(spark, sf_dir), T).select(
        "regime", "method", "label", "ord", "tgt_norm_ppl_median", "tgt_norm_ppl_std",
        "tgt_mbp_median", "tgt_mbp_std", "bytes_per_token", "n_cells"))


@register("report_pair", O.with_ctes(["metrics"], recursive=True, select=f"""
, {SKELETON}, {CELLS},
st AS (
  SELECT regime, method,
         median(CASE WHEN {_pair_ok(T)} THEN sum_norm_ppl END) AS a1,
         stddev_pop(CASE WHEN {_pair_ok(T)} THEN sum_norm_ppl END) AS a2,
         median(CASE WHEN {_pair_ok(T)} THEN src_mbp + tgt_mbp END) AS a3,
         stddev_pop(CASE WHEN {_pair_ok(T)} THEN src_mbp + tgt_mbp END) AS a4,
         count(CASE WHEN {_pair_ok(T)} THEN sum_norm_ppl END) AS a5
  FROM cells GROUP BY regime, method)
SELECT s.regime, s.method, s.label, CAST(s.ord AS BIGINT) AS ord,
       round(a1, 6) AS sum_norm_ppl_median, round(a2, 6) AS sum_norm_ppl_std,
       round(a3, 6) AS sum_mbp_median, round(a4, 6) AS sum_mbp_std, CAST(a5 AS BIGINT) AS n_cells
FROM skel s LEFT JOIN st ON st.regime = s.regime AND st.method = s.method"""))
def report_pair(spark, sf_dir):
    """AGG-9: source + target table per regime x method."""
    return finish(R.report_pair(tb.metrics(spark, sf_dir), T).select(
        "regime", "method", "label", "ord", "sum_norm_ppl_median", "sum_norm_ppl_std",
        "sum_mbp_median", "sum_mbp_std", "n_cells"))


@register("bilingual_medians", O.with_ctes(["metrics"], recursive=True, select=f"""
, {SKELETON}, {CELLS},
st AS (
  SELECT regime, method,
         median(CASE WHEN {_pair_ok(T)} THEN src_norm_ppl END) AS src_ppl,
         median(CASE WHEN {_pair_ok(T)} THEN tgt_norm_ppl END) AS tgt_ppl,
         median(CASE WHEN {_pair_ok(T)} THEN src_mbp END) AS src_mbp,
         median(CASE WHEN {_ok('tgt', T)} THEN tgt_mbp END) AS tgt_mbp
  FROM cells GROUP BY regime, method)
SELECT s.regime, s.method, s.label, round(src_ppl, 6) AS src_ppl, round(tgt_ppl, 6) AS tgt_ppl,
       round(src_mbp, 6) AS src_mbp, round(tgt_mbp, 6) AS tgt_mbp
FROM skel s LEFT JOIN st ON st.regime = s.regime AND st.method = s.method"""))
def bilingual_medians(spark, sf_dir):
    """AGG-10: scatter data per regime x method."""
    return finish(R.bilingual_medians(tb.metrics(spark, sf_dir), T).select(
        "regime", "method", "label", "src_ppl", "tgt_ppl", "src_mbp", "tgt_mbp"))


#: The languages of the test tables (the oracles cannot list columns by data).
_LANGS = ("DE", "EN", "ES", "FR")
_PAIRS = tuple(f"{a}-{b}" for a in _LANGS for b in _LANGS if a != b)


def _columns(key: str, value: str, names) -> str:
    return ", ".join(f"max({value}) FILTER (WHERE {key} = '{n}') AS \"{n}\"" for n in names)


def _pivot_sql(side: str, gate: str) -> str:
    return O.with_ctes(["metrics"], recursive=True, select=f"""
, {CELLS},
c AS (SELECT {side}, regime, method, {_label_sql()} AS label, CAST({_ord_sql()} AS BIGINT) AS ord,
             upper(substring(src_lang, 1, 3)) || '-' || upper(substring(tgt_lang, 1, 3)) AS pair,
             round(CASE WHEN {gate} THEN sum_norm_ppl END, 6) AS v
      FROM cells)
SELECT {side}, regime, method, label, ord, {_columns("pair", "v", _PAIRS)}
FROM c GROUP BY {side}, regime, method, label, ord""")


@register("report_pivot_src", _pivot_sql("src_lang", _pair_ok(T)))
def report_pivot_src(spark, sf_dir):
    """AGG-11 / SRT-4: per-source pivot of summed bits per byte."""
    return finish(R.pivot_by_source(tb.metrics(spark, sf_dir), T, values=tb.pair_list(spark, sf_dir)))


@register("report_pivot_tgt", _pivot_sql("tgt_lang", _ok("tgt", T)))
def report_pivot_tgt(spark, sf_dir):
    """AGG-12: per-target pivot, gated by the target side only."""
    return finish(R.pivot_by_target(tb.metrics(spark, sf_dir), T, values=tb.pair_list(spark, sf_dir)))


MED_SQL = O.with_ctes(["metrics"], recursive=True, select=f"""
, {CELLS},
per AS (SELECT {_label_sql()} AS label, regime, method, upper(src_lang) AS col,
               median(CASE WHEN {_pair_ok(T)} THEN round(sum_norm_ppl + sign(sum_norm_ppl) * 1e-9, 3) END) AS m
        FROM cells GROUP BY label, regime, method, col)""")


@register("language_medians", MED_SQL + f"""
SELECT label, regime, method, {_columns("col", "round(m, 6)", _LANGS)}
FROM per GROUP BY label, regime, method""")
def language_medians(spark, sf_dir):
    """AGG-13 / FN-9: median of each per-source pivot row, languages as columns."""
    return finish(R.language_medians(tb.metrics(spark, sf_dir), T, langs=tb.lang_list(spark, sf_dir)))


@register("report_ranked", TARGET_SQL + """
, rk AS (
  SELECT *, (label LIKE '%100 MB src%' OR label LIKE '%10 MB tgt%') AS is_baseline,
         round(tgt_norm_ppl_median + sign(tgt_norm_ppl_median) * 1e-9, 3) AS r1,
         round(tgt_mbp_median + sign(tgt_mbp_median) * 1e-9, 3) AS r2
  FROM tgt_table)
SELECT label, regime, method,
       CAST(row_number() OVER (ORDER BY is_baseline DESC, ord) AS BIGINT) AS rank,
       r1 AS tgt_norm_ppl, r2 AS tgt_mbp, round(bytes_per_token + sign(bytes_per_token) * 1e-9, 2) AS bytes_per_token,
       CAST(coalesce(r1 = min(r1) OVER (), false) AS BIGINT) AS best_norm_ppl,
       CAST(coalesce(r2 = max(r2) OVER (), false) AS BIGINT) AS best_mbp
FROM rk""")
def report_ranked(spark, sf_dir):
    """SRT-1 / SRT-2 / FN-7: the target table with baselines first and the
    best cell of each column marked (min for bits per byte, max for accuracy,
    compared at 3 decimals, all ties marked)."""
    t = R.report_target(tb.metrics(spark, sf_dir), T)
    r = R.rank_report(t, best_min=["tgt_norm_ppl_median"], best_max=["tgt_mbp_median"])
    return finish(r.select(
        "label", "regime", "method", "rank",
        R.round_half_up("tgt_norm_ppl_median", 3).alias("tgt_norm_ppl"),
        R.round_half_up("tgt_mbp_median", 3).alias("tgt_mbp"),
        R.round_half_up("bytes_per_token", 2).alias("bytes_per_token"),
        F.col("is_best_tgt_norm_ppl_median").cast("long").alias("best_norm_ppl"),
        F.col("is_best_tgt_mbp_median").cast("long").alias("best_mbp")))


@register("report_best_cell", MED_SQL + """
SELECT label, col, round(m + sign(m) * 1e-9, 3) AS value FROM per WHERE m IS NOT NULL
ORDER BY round(m + sign(m) * 1e-9, 3), (label LIKE '%100 MB src%' OR label LIKE '%10 MB tgt%') DESC,
         """ + _ord_sql() + """, col LIMIT 1""")
def report_best_cell(spark, sf_dir):
    """SRT-3: the one best cell of the language-median table (on ties the first
    in row-major order, baselines first)."""
    med = R.language_medians(tb.metrics(spark, sf_dir), T, langs=tb.lang_list(spark, sf_dir))
    cols = [c for c in med.columns if c not in ("label", "regime", "method")]
    return finish(R.best_cell(R.rank_report(R.with_labels(med)), "label", sorted(cols), order="rank"))


def _shown(x: str) -> str:
    return f"printf('%.3f', round({x} + sign({x}) * 1e-9, 3))"


@register("report_text", TARGET_SQL + f"""
, shown AS (
  SELECT label, coalesce({_shown('tgt_norm_ppl_median')} || ' (std=' || {_shown('tgt_norm_ppl_std')} || ')', 'N/A') AS norm_ppl,
         coalesce({_shown('tgt_mbp_median')} || ' (std=' || {_shown('tgt_mbp_std')} || ')', 'N/A') AS mbp,
         coalesce({_shown('bytes_per_token')}, 'N/A') AS bpt
  FROM tgt_table)
SELECT *, TRY_CAST(split_part(norm_ppl, ' ', 1) AS DOUBLE) AS norm_ppl_number, TRY_CAST(split_part(mbp, ' ', 1) AS DOUBLE) AS mbp_number,
       TRY_CAST(bpt AS DOUBLE) AS bpt_number FROM shown""")
def report_text(spark, sf_dir):
    """FN-7 / FN-9: the target table as it is shown, ``median (std=..)`` or ``N/A``, and the numbers read back from the
    shown cells."""
    t = R.report_target(tb.metrics(spark, sf_dir), T).select(
        "label", R.format_stat("tgt_norm_ppl_median", "tgt_norm_ppl_std").alias("norm_ppl"),
        R.format_stat("tgt_mbp_median", "tgt_mbp_std").alias("mbp"), R.format_stat("bytes_per_token").alias("bpt"))
    return finish(t.select("*", *(R.to_number(c).alias(f"{c}_number") for c in ("norm_ppl", "mbp", "bpt"))))
