"""Scoring queries: tokenization, the count model, perplexity, compression,
multiple choice and minimal pairs (JOB-1/2/6..10, AGG-1..7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from transvoc import oracle as O
from transvoc import testbed as tb
from transvoc.catalog import finish, register
from transvoc.operators import lm as lm_ops
from transvoc.operators import metrics
from transvoc.operators.tokenize import encode, encode_long, token_rows, tokenize_with_artifact, with_vocab_langs
from transvoc.operators.trie import greedy_pieces
from transvoc.operators.vocab import CLS_ID, UNK_ID
from transvoc.session import scratch_path
from transvoc.sources.mcq import read_mcq, read_min_pairs, write_mcq

# ---------------------------------------------------------------- norm_ppl

NORM_PPL_SQL = O.with_ctes(["dev_per_line", "devtest"], """
, blanks AS (SELECT lang, count(*) AS n_blank FROM devtest WHERE line = '' GROUP BY lang)
SELECT p.vocab_lang, p.lang,
       round(avg(surprisal), 6) AS log_ppl,
       round(avg(surprisal / nbytes), 6) AS norm_ppl,
       round(avg(n_unk / n_counted), 6) AS uid_prop,
       CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(trunc) AS BIGINT) AS n_truncated,
       CAST(coalesce(any_value(b.n_blank), 0) AS BIGINT) AS n_blank
FROM dev_per_line p LEFT JOIN blanks b ON b.lang = p.lang
GROUP BY p.vocab_lang, p.lang
""")


@register("norm_ppl", NORM_PPL_SQL)
def norm_ppl(spark, sf_dir):
    """JOB-8, the flagship: bits per byte of every devtest language under every
    language's vocabulary and bigram model."""
    m = tb.models(spark, sf_dir)
    res = metrics.evaluate_ppl(tb.devtest(spark, sf_dir), m.vocab, m.lm, mode="word", pairs="all",
                               max_len=tb.MAX_SEQ_LEN, alpha=tb.ALPHA,
                               known_entries=m.known, info=m.info, ctx=m.ctx)
    return finish(res.select("vocab_lang", "lang", "log_ppl", "norm_ppl", "uid_prop",
                             "n_lines", "n_truncated", "n_blank"))


# ---------------------------------------------------------------- vocabulary / encoding

@register("build_vocab", O.with_ctes(["vocab"], """
SELECT lang, token, CAST(id AS BIGINT) AS id, CAST(n AS BIGINT) AS n FROM vocab"""))
def build_vocab(spark, sf_dir):
    """JOB-2: top-k words per language, ids after the reserved ones."""
    return finish(tb.models(spark, sf_dir).vocab)


@register("encode_lines", O.with_ctes(["dev_enc", "devtest"], f"""
SELECT e.vocab_lang, e.lang, e.doc_id, CAST(e.line_no AS BIGINT) AS line_no,
       '2' || coalesce(',' || array_to_string(list(e.token_id ORDER BY e.pos)
                       FILTER (WHERE e.pos < {tb.MAX_SEQ_LEN - 1}), ','), '') AS ids,
       CAST(count(*) AS BIGINT) AS n_tokens,
       CAST(count(*) FILTER (WHERE e.token_id = 1) AS BIGINT) AS n_unk
FROM dev_enc e GROUP BY e.vocab_lang, e.lang, e.doc_id, e.line_no"""))
def encode_lines(spark, sf_dir):
    """JOB-1 / JN-7 / SRT-5: every devtest line under every vocabulary;
    ``[cls] + ids`` truncated to the model context."""
    m = tb.models(spark, sf_dir)
    enc = encode(tb.devtest(spark, sf_dir).filter(F.col("line") != ""), m.vocab,
                 "word", "all", known_entries=m.known, info=m.info)
    return finish(enc.select(
        "vocab_lang", "lang", "doc_id", "line_no",
        F.array_join(F.slice(F.concat(F.array(F.lit(CLS_ID)), "ids"), 1, tb.MAX_SEQ_LEN), ",")
        .alias("ids"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.size(F.filter("ids", lambda x: x == UNK_ID)).cast("long").alias("n_unk")))


@register("custom_tokenizer", O.with_ctes(["dev_enc"], """
SELECT e.vocab_lang, e.lang, e.doc_id, CAST(e.line_no AS BIGINT) AS line_no,
       array_to_string(list(e.token_id ORDER BY e.pos), ',') AS ids,
       CAST(count(*) AS BIGINT) AS n_tokens
FROM dev_enc e GROUP BY e.vocab_lang, e.lang, e.doc_id, e.line_no"""))
def custom_tokenizer(spark, sf_dir):
    """UDF-2: a user tokenizer (here: a Python word lookup, as a tokenizer model would be loaded) of every
    vocabulary, read by the workers from the shared folder, applied through an Arrow-batched pandas UDF."""
    m = tb.models(spark, sf_dir)
    path = scratch_path(spark, "tokenizers")
    m.vocab.select("lang", "token", "id").write.parquet(path)

    def load(table: pa.Table) -> dict[str, dict[str, int]]:
        tables: dict[str, dict[str, int]] = {}
        for lang, token, i in zip(*(table.column(c).to_pylist() for c in ("lang", "token", "id")), strict=True):
            tables.setdefault(lang, {})[token] = i
        return tables

    def tok(tables: dict[str, dict[str, int]], lang: pd.Series, line: pd.Series) -> pd.Series:
        return pd.Series([[] if t == "" else [tables[v].get(w, UNK_ID) for w in t.split(" ")]
                          for v, t in zip(lang, line, strict=True)])

    udf = tokenize_with_artifact(path, load, tok)
    d = with_vocab_langs(tb.devtest(spark, sf_dir).filter(F.col("line") != ""), m.vocab, "all", m.info)
    out = d.select("vocab_lang", "lang", "doc_id", "line_no", udf("vocab_lang", "line").alias("ids"))
    return finish(out.select("vocab_lang", "lang", "doc_id", "line_no", F.array_join("ids", ",").alias("ids"),
                             F.size("ids").cast("long").alias("n_tokens")))


# Every distinct devtest word under every vocabulary, walked piece by piece.
O.cte("greedy_words", ["dev_tokens", "vlangs"], """
SELECT l.vocab_lang, w.word FROM (SELECT DISTINCT token AS word FROM dev_tokens) w CROSS JOIN vlangs l""")
O.cte("greedy_best", ["greedy_words", "piece_vocab"], """
SELECT vocab_lang, word, s, max(l) AS l, arg_max(id, l) AS id FROM (
  SELECT x.vocab_lang, x.word, x.s, x.l, p.id
  FROM (SELECT vocab_lang, word, s, unnest(range(1, least((SELECT max(length(token)) FROM piece_vocab),
                                                          length(word) - s + 1) + 1)) AS l
        FROM (SELECT vocab_lang, word, unnest(range(1, length(word) + 1)) AS s FROM greedy_words)) x
  JOIN piece_vocab p ON p.lang = x.vocab_lang AND p.token = substring(x.word, x.s, x.l))
GROUP BY vocab_lang, word, s""")
O.cte("greedy_walk", ["greedy_words", "greedy_best"], """
SELECT vocab_lang, word, 1 AS nxt, []::INTEGER[] AS ids FROM greedy_words
UNION ALL
SELECT w.vocab_lang, w.word, w.nxt + coalesce(b.l, 1), list_append(w.ids, coalesce(b.id, 1))
FROM greedy_walk w LEFT JOIN greedy_best b ON b.vocab_lang = w.vocab_lang AND b.word = w.word AND b.s = w.nxt
WHERE w.nxt <= length(w.word)""")
O.cte("greedy_ids", ["greedy_walk"], "SELECT vocab_lang, word, ids FROM greedy_walk WHERE nxt > length(word)")


@register("greedy_pieces", O.with_ctes(["greedy_ids"], """
SELECT vocab_lang, word, array_to_string(ids, ',') AS pieces, CAST(len(ids) AS BIGINT) AS n_pieces
FROM greedy_ids""", recursive=True))
def greedy_pieces_q(spark, sf_dir):
    """JOB-1 greedy mode: longest-match pieces of every distinct devtest word
    under every language's piece vocabulary (words + characters)."""
    pv = tb.models(spark, sf_dir).pieces
    words = (token_rows(tb.devtest(spark, sf_dir), ["lang"]).select(F.col("token").alias("word"))
             .distinct())
    wv = with_vocab_langs(words.withColumn("lang", F.lit("")), pv, "all").select("vocab_lang", "word")
    res = greedy_pieces(wv, pv)
    return finish(res.select("vocab_lang", "word", F.array_join("ids", ",").alias("pieces"),
                             F.size("ids").cast("long").alias("n_pieces")))


O.cte("compression", ["dev_tokens", "devtest", "greedy_ids"], """
SELECT t.vocab_lang, t.lang, d.n_bytes / (t.n_pieces + 2 * d.n_lines) AS bpt, d.n_bytes,
       t.n_pieces + 2 * d.n_lines AS n_tokens
FROM (SELECT g.vocab_lang, w.lang, sum(len(g.ids) * w.n) AS n_pieces
      FROM (SELECT lang, token, count(*) AS n FROM dev_tokens GROUP BY lang, token) w
      JOIN greedy_ids g ON g.word = w.token GROUP BY g.vocab_lang, w.lang) t
JOIN (SELECT lang, sum(strlen(line)) AS n_bytes, count(*) AS n_lines FROM devtest GROUP BY lang) d USING (lang)""")


@register("token_compression", O.with_ctes(["compression"], """
SELECT vocab_lang, lang, round(bpt, 6) AS bpt, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_tokens AS BIGINT) AS n_tokens
FROM compression""", recursive=True))
def token_compression(spark, sf_dir):
    """AGG-5: bytes per token of every vocabulary's greedy tokenizer on every language."""
    return finish(metrics.bytes_per_token(tb.devtest(spark, sf_dir), tb.models(spark, sf_dir).pieces))


# ---------------------------------------------------------------- count model and scores

@register("lm_counts", O.with_ctes(["lm"], """
SELECT lang, CAST(prev AS BIGINT) AS prev, CAST(tok AS BIGINT) AS tok, CAST(n AS BIGINT) AS n FROM lm"""))
def lm_counts(spark, sf_dir):
    """JOB-6: bigram counts of every language's pool under its own vocabulary."""
    return finish(tb.models(spark, sf_dir).lm)


@register("token_scores", O.with_ctes(["dev_scored"], """
SELECT vocab_lang, lang, doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(pos AS BIGINT) AS pos,
       CAST(token_id AS BIGINT) AS token_id, CAST(prev AS BIGINT) AS prev_id,
       round(nats, 6) AS loss_nats
FROM dev_scored"""))
def token_scores(spark, sf_dir):
    """JOB-7: the ``token_loss`` table - every devtest token under every model."""
    m = tb.models(spark, sf_dir)
    rows = encode_long(tb.devtest(spark, sf_dir), m.vocab, "all",
                       known_entries=m.known, info=m.info)
    tl = lm_ops.score(rows, m.lm, tb.VOCAB_SIZE, alpha=tb.ALPHA, ctx=m.ctx, ctx_bound=m.ctx.count(), lm_rows=m.lm.count())
    return finish(tl.select("vocab_lang", "lang", "doc_id", "line_no", "pos", "token_id",
                            "prev_id", "loss_nats"))


def _ppl_lines(spark, sf_dir, scorer=None):
    d = tb.devtest(spark, sf_dir).filter(F.col("line") != "")
    m = tb.models(spark, sf_dir)
    return metrics.ppl_lines(d, m.vocab, m.lm, "word", "all", tb.MAX_SEQ_LEN, tb.ALPHA,
                             known_entries=m.known, scorer=scorer, info=m.info,
                             ctx=None if scorer is not None else m.ctx)


@register("line_surprisal", O.with_ctes(["dev_per_line"], """
SELECT vocab_lang, lang, doc_id, CAST(line_no AS BIGINT) AS line_no,
       round(surprisal, 6) AS surprisal, CAST(n_unk AS BIGINT) AS n_unk,
       CAST(n_counted AS BIGINT) AS n_labels, CAST(nbytes AS BIGINT) AS nbytes,
       CAST(trunc AS BIGINT) AS truncated
FROM dev_per_line"""))
def line_surprisal(spark, sf_dir):
    """AGG-1 with FN-4/12/13 and WIN-4: per-line bits of the second half."""
    pl = _ppl_lines(spark, sf_dir)
    return finish(pl.select("vocab_lang", "lang", "doc_id", "line_no", "surprisal", "n_unk",
                            F.col("n_counted").alias("n_labels"), "nbytes", "truncated"))


@register("uid_prop", O.with_ctes(["dev_per_line"], """
SELECT vocab_lang, lang, round(avg(n_unk / n_counted), 6) AS uid_prop,
       round(sum(n_unk) / sum(n_counted), 6) AS unk_token_share,
       CAST(count(*) AS BIGINT) AS n_lines
FROM dev_per_line GROUP BY vocab_lang, lang"""))
def uid_prop(spark, sf_dir):
    """AGG-4: mean per-line unknown share (mean of ratios), next to the
    corpus-level share (ratio of sums) for contrast."""
    pl = _ppl_lines(spark, sf_dir)
    return finish(pl.groupBy("vocab_lang", "lang").agg(
        F.avg(F.col("n_unk") / F.col("n_counted")).alias("uid_prop"),
        (F.sum("n_unk") / F.sum("n_counted")).alias("unk_token_share"),
        F.count(F.lit(1)).alias("n_lines")))


def _by_ids(batch: pd.DataFrame) -> pd.Series:
    """A black-box model for the hook: a loss that tells every token and its
    predecessor apart, so that a lost key or order would show."""
    return np.log(2.0 + batch["token_id"].astype("float64") + 3.0 * batch["prev_id"].astype("float64"))


@register("custom_scorer", O.with_ctes(["dev_labels", "dev_info"], f"""
, pl AS (
  SELECT s.vocab_lang, s.lang, s.doc_id, s.line_no,
         sum(CASE WHEN s.pos < i.h THEN 0.0 WHEN s.token_id = 1 THEN log2({tb.VOCAB_SIZE})
                  ELSE ln(2.0::DOUBLE + s.token_id + 3 * s.prev) / ln(2) END) AS surprisal,
         any_value(i.nbytes) AS nbytes
  FROM dev_labels s JOIN dev_info i ON i.lang = s.lang AND i.doc_id = s.doc_id AND i.line_no = s.line_no
  WHERE s.pos < {tb.MAX_SEQ_LEN - 1}
  GROUP BY s.vocab_lang, s.lang, s.doc_id, s.line_no)
SELECT vocab_lang, lang, round(avg(surprisal), 6) AS log_ppl,
       round(avg(surprisal / nbytes), 6) AS norm_ppl, CAST(count(*) AS BIGINT) AS n_lines
FROM pl GROUP BY vocab_lang, lang"""))
def custom_scorer(spark, sf_dir):
    """UDF-1: bits per byte with a user-supplied scorer run via mapInPandas."""
    pl = _ppl_lines(spark, sf_dir, scorer=_by_ids)
    return finish(pl.groupBy("vocab_lang", "lang").agg(
        F.avg("surprisal").alias("log_ppl"),
        F.avg(F.col("surprisal") / F.col("nbytes")).alias("norm_ppl"),
        F.count(F.lit(1)).alias("n_lines")))


# ---------------------------------------------------------------- multiple choice, minimal pairs

O.cte("mcq", [], """
SELECT i.item_id, substring(i.text, 1, 2 * length(i.text) // 3) AS passage,
       substring(i.text, 2 * length(i.text) // 3 + 1) AS question,
       CAST(1 + i.item_id % 4 AS INTEGER) AS correct,
       list(a.text ORDER BY j.j) AS answers
FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark) i
CROSS JOIN (SELECT count(*) AS n FROM benchmark) c
CROSS JOIN range(1, 5) j(j)
JOIN (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark) a
  ON a.item_id = (i.item_id + 3 * (j.j - 1) + 1) % c.n
GROUP BY i.item_id, i.text""")
O.cte("mcq_scored", ["mcq", "vocab", "vlangs", "lm", "lm_ctx"], f"""
WITH prompts AS (
  SELECT item_id, correct, CAST(o - 1 AS INTEGER) AS opt,
         concat_ws(' ', {O.strip('passage')}, {O.strip('question')}, {O.strip('answers[o]')}) AS line
  FROM (SELECT *, unnest(range(1, 5)) AS o FROM mcq)
), toks AS (
  SELECT item_id, correct, opt, unnest(ws) AS token, unnest(range(len(ws))) AS pos
  FROM (SELECT *, {O.words('line')} AS ws FROM prompts)
), enc AS (
  SELECT l.vocab_lang, t.item_id, t.correct, t.opt, t.pos, coalesce(v.id, 1) AS token_id
  FROM toks t CROSS JOIN vlangs l LEFT JOIN vocab v ON v.lang = l.vocab_lang AND v.token = t.token
), lab AS (
  SELECT *, coalesce(lag(token_id) OVER (PARTITION BY vocab_lang, item_id, opt ORDER BY pos), 2) AS prev
  FROM enc
)
SELECT x.vocab_lang, x.item_id, x.correct, x.opt, sum({O.whole_loss('b.n', 'c.n_prev')}) AS loss
FROM lab x
LEFT JOIN lm b ON b.lang = x.vocab_lang AND b.prev = x.prev AND b.tok = x.token_id
LEFT JOIN lm_ctx c ON c.lang = x.vocab_lang AND c.prev = x.prev
WHERE x.pos < {tb.MCQ_MAX_LEN - 1}
GROUP BY x.vocab_lang, x.item_id, x.correct, x.opt""")


@register("mcq_items", O.with_ctes(["mcq"], """
SELECT item_id, passage, question, array_to_string(answers, ' || ') AS answers,
       CAST(correct AS BIGINT) AS correct FROM mcq"""))
def mcq_items(spark, sf_dir):
    """SRC-4: items written as JSONL (the multiple-choice file format) and
    read back with the exact-cardinality check."""
    m = tb.mcq(spark, sf_dir)
    path = scratch_path(spark, "mcq_jsonl")
    write_mcq(m, path)
    n = tb.read(spark, sf_dir, "benchmark").count()
    back = read_mcq(spark, path, expect=n)
    return finish(back.select("item_id", "passage", "question",
                              F.array_join("answers", " || ").alias("answers"), "correct"))


@register("mcq_accuracy", O.with_ctes(["mcq_scored"], """
SELECT vocab_lang, round(avg(CASE WHEN opt + 1 = correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS n_items
FROM (SELECT *, row_number() OVER (PARTITION BY vocab_lang, item_id ORDER BY loss, opt) AS rk
      FROM mcq_scored) WHERE rk = 1
GROUP BY vocab_lang"""))
def mcq_accuracy(spark, sf_dir):
    """JOB-9 / WIN-5 / AGG-6: multiple-choice accuracy of every model."""
    m = tb.models(spark, sf_dir)
    res = metrics.evaluate_mcq(tb.mcq(spark, sf_dir), m.vocab, m.lm, "word", tb.MCQ_MAX_LEN,
                               tb.ALPHA, known_entries=m.known, info=m.info, ctx=m.ctx)
    return finish(res)


O.cte("min_pairs", ["devtest"], """
SELECT lang, doc_id, line_no, line AS sen,
       array_to_string(list_reverse(string_split(line, ' ')), ' ') AS wrong_sen
FROM devtest WHERE line <> ''""")
O.cte("mp_sides", ["min_pairs", "vocab", "vlangs", "lm", "lm_ctx"], f"""
WITH sides AS (
  SELECT lang, doc_id, line_no, 0 AS side, sen AS line FROM min_pairs
  UNION ALL SELECT lang, doc_id, line_no, 1 AS side, wrong_sen AS line FROM min_pairs
), toks AS (
  SELECT lang, doc_id, line_no, side, unnest(ws) AS token, unnest(range(len(ws))) AS pos
  FROM (SELECT *, {O.words('line')} AS ws FROM sides)
), enc AS (
  SELECT l.vocab_lang, t.lang, t.doc_id, t.line_no, t.side, t.pos, coalesce(v.id, 1) AS token_id
  FROM toks t CROSS JOIN vlangs l LEFT JOIN vocab v ON v.lang = l.vocab_lang AND v.token = t.token
), lab AS (
  SELECT *, coalesce(lag(token_id) OVER (PARTITION BY vocab_lang, lang, doc_id, line_no, side
                                         ORDER BY pos), 2) AS prev FROM enc
)
SELECT x.vocab_lang, x.lang, x.doc_id, x.line_no, x.side,
       sum({O.whole_loss('b.n', 'c.n_prev')}) AS nll, count(*) AS ntok
FROM lab x
LEFT JOIN lm b ON b.lang = x.vocab_lang AND b.prev = x.prev AND b.tok = x.token_id
LEFT JOIN lm_ctx c ON c.lang = x.vocab_lang AND c.prev = x.prev
GROUP BY x.vocab_lang, x.lang, x.doc_id, x.line_no, x.side""")


@register("minimal_pairs", O.with_ctes(["min_pairs"], """
SELECT lang, doc_id, CAST(line_no AS BIGINT) AS line_no, sen, wrong_sen FROM min_pairs"""))
def minimal_pairs(spark, sf_dir):
    """SRC-5: minimal pairs (correct sentence, words reversed) of every language, and of lines without one."""
    pairs = tb.min_pairs(spark, sf_dir)
    return finish(read_min_pairs(pairs, *tb.lang_list(spark, sf_dir)).unionByName(pairs.where(F.col("lang").isNull())))


@register("minimal_pair_accuracy", O.with_ctes(["mp_sides"], f"""
, pp AS (
  SELECT vocab_lang, lang, doc_id, line_no,
         sum(CASE WHEN side = 0 THEN nll ELSE 0 END) AS sen_nll,
         sum(CASE WHEN side = 1 THEN nll ELSE 0 END) AS wrong_nll,
         max(ntok) >= {tb.MIN_PAIR_MAX_LEN} AS over
  FROM mp_sides GROUP BY vocab_lang, lang, doc_id, line_no)
SELECT vocab_lang, lang,
       round(avg(CASE WHEN NOT over AND wrong_nll - sen_nll > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS n_pairs,
       CAST(sum(CASE WHEN over THEN 1 ELSE 0 END) AS BIGINT) AS n_over
FROM pp GROUP BY vocab_lang, lang"""))
def minimal_pair_accuracy(spark, sf_dir):
    """JOB-10 / AGG-7: minimal-pair accuracy per (model, language)."""
    m = tb.models(spark, sf_dir)
    res = metrics.evaluate_min_pairs(tb.min_pairs(spark, sf_dir), m.vocab, m.lm, "word",
                                     tb.MIN_PAIR_MAX_LEN, tb.ALPHA, known_entries=m.known,
                                     info=m.info, ctx=m.ctx)
    return finish(res)
