"""DuckDB SQL for the driver's correctness gate.

Every registered query has an equivalent ANSI-ish SQL text here, written from
the semantics (not from the Spark plan).  Shared relations are CTEs that are
pulled in by name with their dependencies, so each oracle is one
self-contained ``WITH ... SELECT`` over the pre-registered tables.
"""

from __future__ import annotations

from transvoc.testbed import (ALPHA, DEVTEST_MOD, MAX_SEQ_LEN, MCQ_MAX_LEN, MIN_PAIR_MAX_LEN,
                              TRAIN_SHARE, VALID_SHARE, VOCAB_K, VOCAB_SIZE)

STRIP = r"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


# name -> (dependencies, body)
CTES: dict[str, tuple[list[str], str]] = {}
HEADS: dict[str, str] = {}  # columns and keys of recursive relations that keep one row a key


def cte(name: str, deps: list[str], body: str, head: str = "") -> None:
    CTES[name], HEADS[name] = (deps, body), head


cte("lines", [], f"""
SELECT lang, doc_id, CAST(line_no AS INTEGER) AS line_no, {strip('raw')} AS line
FROM (SELECT lang, doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no
      FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
cte("pool", ["lines"], f"SELECT * FROM lines WHERE doc_id % 10 <> {DEVTEST_MOD}")
cte("devtest", ["lines"], f"SELECT * FROM lines WHERE doc_id % 10 = {DEVTEST_MOD}")
cte("premium", [], """
SELECT * FROM (VALUES ('de', 1.053648018), ('en', 1.0), ('es', 1.08), ('fr', 1.09)) AS p(lang, factor)""")
cte("pool_tokens", ["pool"], f"""
SELECT lang, doc_id, line_no, CAST(p - 1 AS INTEGER) AS pos, w AS token
FROM (SELECT lang, doc_id, line_no, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p
      FROM (SELECT lang, doc_id, line_no, {words('line')} AS ws FROM pool))""")
cte("dev_tokens", ["devtest"], f"""
SELECT lang, doc_id, line_no, CAST(p - 1 AS INTEGER) AS pos, w AS token
FROM (SELECT lang, doc_id, line_no, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p
      FROM (SELECT lang, doc_id, line_no, {words('line')} AS ws FROM devtest))""")
cte("vocab", ["pool_tokens"], f"""
SELECT lang, token, CAST(rn + 3 AS INTEGER) AS id, n
FROM (SELECT lang, token, n,
             row_number() OVER (PARTITION BY lang ORDER BY n DESC, token ASC) AS rn
      FROM (SELECT lang, token, count(*) AS n FROM pool_tokens GROUP BY lang, token))
WHERE rn <= {VOCAB_K}""")
cte("vlangs", ["vocab"], "SELECT DISTINCT lang AS vocab_lang FROM vocab")
cte("piece_vocab", ["vocab", "pool_tokens"], """
SELECT lang, token, id FROM vocab
UNION ALL
SELECT c.lang, c.ch AS token,
       CAST(m.mx + row_number() OVER (PARTITION BY c.lang ORDER BY c.ch) AS INTEGER) AS id
FROM (SELECT DISTINCT lang, substring(token, i, 1) AS ch FROM (
        SELECT lang, token, unnest(range(1, length(token) + 1)) AS i
        FROM (SELECT DISTINCT lang, token FROM pool_tokens))) c
JOIN (SELECT lang, max(id) AS mx FROM vocab GROUP BY lang) m ON m.lang = c.lang
WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.lang = c.lang AND v.token = c.ch)""")
# own-language encoding of the pool (for the bigram model)
cte("pool_enc", ["pool_tokens", "vocab"], """
SELECT t.lang, t.doc_id, t.line_no, t.pos, coalesce(v.id, 1) AS token_id
FROM pool_tokens t LEFT JOIN vocab v ON v.lang = t.lang AND v.token = t.token""")
cte("lm", ["pool_enc"], """
SELECT lang, prev, tok, count(*) AS n FROM (
  SELECT lang, token_id AS tok,
         coalesce(lag(token_id) OVER (PARTITION BY lang, doc_id, line_no ORDER BY pos), 2) AS prev
  FROM pool_enc) GROUP BY lang, prev, tok""")
cte("lm_ctx", ["lm"], "SELECT lang, prev, sum(n) AS n_prev FROM lm GROUP BY lang, prev")
# devtest tokens under every vocabulary
cte("dev_enc", ["dev_tokens", "vocab", "vlangs"], """
SELECT l.vocab_lang, t.lang, t.doc_id, t.line_no, t.pos, coalesce(v.id, 1) AS token_id
FROM dev_tokens t CROSS JOIN vlangs l
LEFT JOIN vocab v ON v.lang = l.vocab_lang AND v.token = t.token""")


def with_ctes(names: list[str], select: str, recursive: bool = False) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``select``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n}{HEADS[n]} AS ({CTES[n][1].strip()})" for n in order]
    if not parts:
        return select.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + select.strip()


def loss_expr(c: str, n: str) -> str:
    return f"-ln((coalesce({c}, 0) + {ALPHA}) / (coalesce({n}, 0) + {ALPHA} * {VOCAB_SIZE}))"


def whole_loss(c: str, n: str) -> str:
    """In whole 1e-12 nats, so that sums have no order."""
    return f"CAST(round({loss_expr(c, n)} * 1e12) AS BIGINT)"


PARAMS = dict(ALPHA=ALPHA, MAX_SEQ_LEN=MAX_SEQ_LEN, MCQ_MAX_LEN=MCQ_MAX_LEN,
              MIN_PAIR_MAX_LEN=MIN_PAIR_MAX_LEN, VOCAB_SIZE=VOCAB_SIZE)


# ---- scoring relations shared by several oracles
cte("dev_labels", ["dev_enc"], f"""
SELECT e.vocab_lang, e.lang, e.doc_id, e.line_no, e.pos, e.token_id,
       coalesce(lag(e.token_id) OVER (PARTITION BY e.vocab_lang, e.lang, e.doc_id, e.line_no
                                      ORDER BY e.pos), 2) AS prev
FROM dev_enc e""")
cte("dev_scored", ["dev_labels", "lm", "lm_ctx"], f"""
SELECT l.*, {loss_expr('b.n', 'c.n_prev')} AS nats,
       CASE WHEN l.token_id = 1 THEN log2({VOCAB_SIZE})
            WHEN l.token_id = 0 THEN 0.0
            ELSE {loss_expr('b.n', 'c.n_prev')} / ln(2) END AS bits
FROM dev_labels l
LEFT JOIN lm b ON b.lang = l.vocab_lang AND b.prev = l.prev AND b.tok = l.token_id
LEFT JOIN lm_ctx c ON c.lang = l.vocab_lang AND c.prev = l.prev""")
cte("dev_info", ["devtest"], f"""
SELECT lang, doc_id, line_no,
       len({words('substring(line, 1, length(line) // 2)')}) AS h,
       strlen(substring(line, length(line) // 2 + 1)) AS nbytes,
       CASE WHEN len({words('line')}) + 1 > {MAX_SEQ_LEN} THEN 1 ELSE 0 END AS trunc
FROM devtest WHERE line <> ''""")
cte("dev_per_line", ["dev_scored", "dev_info"], f"""
SELECT s.vocab_lang, s.lang, s.doc_id, s.line_no,
       sum(CASE WHEN s.pos >= i.h THEN s.bits ELSE 0.0 END) AS surprisal,
       sum(CASE WHEN s.token_id = 1 THEN 1 ELSE 0 END) AS n_unk,
       count(*) AS n_counted,
       any_value(i.nbytes) AS nbytes, any_value(i.trunc) AS trunc
FROM dev_scored s JOIN dev_info i ON i.lang = s.lang AND i.doc_id = s.doc_id AND i.line_no = s.line_no
WHERE s.pos < {MAX_SEQ_LEN - 1}
GROUP BY s.vocab_lang, s.lang, s.doc_id, s.line_no""")

cte("sampled", ["lines", "premium"], """
WITH c AS (
  SELECT l.lang, l.doc_id, l.line_no, l.line, strlen(l.line) AS bytes, p.factor,
         coalesce(sum(strlen(l.line)) OVER (PARTITION BY l.lang ORDER BY l.doc_id, l.line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lines l JOIN premium p ON p.lang = l.lang
), t AS (SELECT lang, min(before) AS tt FROM c WHERE before > 100000 * factor GROUP BY lang)
SELECT c.lang, c.doc_id, c.line_no, c.line, c.bytes, c.before,
       CASE WHEN c.before <= 100000 * c.factor THEN 'train' ELSE 'valid' END AS split
FROM c LEFT JOIN t ON t.lang = c.lang
WHERE c.before <= 100000 * c.factor OR c.before - t.tt <= 10000 * c.factor""")

cte("sampled_share", ["lines"], f"""
WITH p AS (SELECT lang, sum(strlen(line)) AS factor FROM lines GROUP BY lang),
c AS (
  SELECT l.lang, l.doc_id, l.line_no, l.line, strlen(l.line) AS bytes, p.factor::DOUBLE AS factor,
         coalesce(sum(strlen(l.line)) OVER (PARTITION BY l.lang ORDER BY l.doc_id, l.line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lines l JOIN p ON p.lang = l.lang
), t AS (SELECT lang, min(before) AS tt FROM c WHERE before > {TRAIN_SHARE}::DOUBLE * factor GROUP BY lang)
SELECT c.lang, c.doc_id, c.line_no, c.line, c.bytes, c.before,
       CASE WHEN c.before <= {TRAIN_SHARE}::DOUBLE * c.factor THEN 'train' ELSE 'valid' END AS split
FROM c LEFT JOIN t ON t.lang = c.lang
WHERE c.before <= {TRAIN_SHARE}::DOUBLE * c.factor OR c.before - t.tt <= {VALID_SHARE}::DOUBLE * c.factor""")

cte("mapping", [], """
SELECT lang, lower('models/' || lang || '_100MB') AS source, lower('models/' || lang || '_10MB') AS target,
       'data/train/' || lower(lang || '.txt') AS train, 'data/valid/' || lower(lang || '.txt') AS valid
FROM (SELECT DISTINCT lang FROM documents)""")
cte("tplan", ["mapping"], """
SELECT s.lang AS src_lang, t.lang AS tgt_lang, s.source AS src_model, t.target AS tgt_model,
       s.train AS src_train, s.valid AS src_valid, t.train AS tgt_train, t.valid AS tgt_valid,
       m.method, s.lang || '-' || t.lang || '-' || m.method AS model
FROM mapping s JOIN mapping t ON s.lang <> t.lang CROSS JOIN (VALUES ('fvt'), ('omp')) m(method)""")
cte("manifest", ["tplan"], """
SELECT *, false AS finetuned FROM tplan
UNION ALL
SELECT src_lang, tgt_lang, src_model, tgt_model, src_train, src_valid, tgt_train, tgt_valid, method,
       model || '_finetuned' AS model, true AS finetuned FROM tplan""")
cte("ft_jobs", ["manifest"], """
WITH m AS (SELECT * FROM manifest CROSS JOIN (VALUES ('mono-finetuning', false), ('mixed-finetuning', true)) r(regime, combine)
           WHERE NOT finetuned),
jobs AS (
  SELECT regime, src_lang, 0 AS kind_ord, 'src_base' AS kind, model, src_model AS model_spec,
         string_split(src_model, '/')[-1] || '_' || tgt_lang || '_finetuned' AS out,
         CASE WHEN combine THEN [src_train, tgt_train] ELSE [tgt_train] END AS train,
         CASE WHEN combine THEN [src_valid, tgt_valid] ELSE [tgt_valid] END AS valid FROM m
  UNION ALL
  SELECT regime, src_lang, 1, 'tgt_base', model, tgt_model,
         string_split(tgt_model, '/')[-1] || '_' || src_lang || '_finetuned',
         CASE WHEN combine THEN [tgt_train, src_train] ELSE [src_train] END,
         CASE WHEN combine THEN [tgt_valid, src_valid] ELSE [src_valid] END FROM m
  UNION ALL
  SELECT regime, src_lang, 2, 'transfer', model, model, string_split(model, '/')[-1] || '_finetuned',
         CASE WHEN combine THEN [src_train, tgt_train] ELSE [tgt_train] END,
         CASE WHEN combine THEN [src_valid, tgt_valid] ELSE [tgt_valid] END FROM m)
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY regime, src_lang, out ORDER BY kind_ord, model) AS rn FROM jobs)
WHERE rn = 1""")
cte("existing", ["manifest"], """
SELECT 'mono-finetuning' AS regime, model || '_finetuned' AS out FROM manifest
WHERE NOT finetuned AND src_lang = 'de'""")
cte("ft_plan", ["ft_jobs", "existing"], """
SELECT * FROM ft_jobs j WHERE NOT EXISTS (
  SELECT 1 FROM existing e WHERE e.regime = j.regime AND e.out = j.out)""")
cte("resolved", ["manifest", "ft_jobs"], """
SELECT m.*, r.regime,
       CASE WHEN m.finetuned THEN string_split(m.src_model, '/')[-1] || '_' || m.tgt_lang || '_finetuned'
            ELSE m.src_model END AS base_model
FROM manifest m JOIN (VALUES (false, 'no-finetuning'), (true, 'mono-finetuning'),
                             (true, 'mixed-finetuning')) r(finetuned, regime) ON r.finetuned = m.finetuned
WHERE NOT m.finetuned OR EXISTS (
  SELECT 1 FROM ft_jobs j WHERE j.regime = r.regime
    AND j.out = string_split(m.src_model, '/')[-1] || '_' || m.tgt_lang || '_finetuned')""")

cte("emb_n", [], "SELECT count(*) AS n FROM embeddings")
