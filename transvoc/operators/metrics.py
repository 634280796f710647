"""Metric jobs over ``token_loss`` (JOB-8..10, AGG-1..7, WIN-4, WIN-5, FN-4, FN-12, FN-13).

Every metric is: encode -> explode labels -> score -> per-line aggregation ->
per-(model, language) aggregation.  All aggregations are algebraic
(sum / count / avg / min_by), so Spark runs them as partial + final
aggregates; no group is ever collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transvoc.functions.text import byte_len, first_half, is_blank, join_prompt, second_half
from transvoc.operators import lm as lm_ops
from transvoc.operators.tokenize import encode, encode_long, with_vocab_langs, words_col
from transvoc.operators.trie import greedy_pieces
from transvoc.operators.vocab import PAD_ID, UNK_ID, counted_words
from transvoc.session import cut_lineage

LN2 = math.log(2.0)


def vocab_sizes(vocab: DataFrame) -> DataFrame:
    """``(vocab_lang, V)`` with ``V = max id + 1`` (reserved ids included)."""
    return vocab.groupBy(F.col("lang").alias("vocab_lang")).agg(
        (F.max("id") + 1).cast("double").alias("V"))


def _scored(rows: DataFrame, lm: DataFrame, alpha: float, scorer=None,
            ctx: DataFrame | None = None) -> DataFrame:
    if scorer is not None:
        return lm_ops.score_with(rows, scorer)
    # context rows: at most one per (model, vocabulary id), counted where they and the bigrams are written tables
    written = ctx is not None
    return lm_ops.score(rows, lm, "V", alpha=alpha, ctx=ctx, ctx_bound=ctx.count() if written else None,
                        lm_rows=lm.count() if written else None)


def _sizes(vocab: DataFrame, info: DataFrame | None) -> DataFrame:
    return F.broadcast(info if info is not None else vocab_sizes(vocab))


def label_rows_for(lines: DataFrame, vocab: DataFrame, mode: str, pairs, keys: Sequence[str],
                   carry: Sequence[str] = (), known_entries: int | None = None,
                   max_labels: int | None = None, info: DataFrame | None = None) -> DataFrame:
    """Label rows ``(vocab_lang, keys..., carry..., pos, token_id, prev_id)``.

    Word mode stays in long form (hash-join lookups, no regroup); greedy mode
    goes through the per-distinct-word pieces and the array form.
    ``max_labels`` keeps the first labels of each line (truncation).
    """
    keys, carry = list(keys), list(carry)
    if mode == "word":
        rows = encode_long(lines.select(*keys, *carry, "line"), vocab, pairs, [*keys, *carry],
                           known_entries=known_entries, info=info).drop("token")
    else:
        arr = encode(lines, vocab, mode, pairs, keys, known_entries=known_entries, carry=carry,
                     info=info)
        rows = lm_ops.label_rows(arr, ["vocab_lang", *keys, *carry])
    if max_labels is not None:
        rows = rows.filter(F.col("pos") < max_labels)
    return rows


def bits(unk: int = UNK_ID, pad: int = PAD_ID):
    """FN-4 + FN-12 + FN-13: nats -> bits; unknown costs log2(V); padding 0."""
    return (F.when(F.col("token_id") == unk, F.log2(F.col("V")))
            .when(F.col("token_id") == pad, F.lit(0.0))
            .otherwise(F.col("loss_nats") / F.lit(LN2)))


def line_surprisal(token_loss: DataFrame, line_keys: Sequence[str], h_col: str | None = "h",
                   spe_id: int | None = None) -> DataFrame:
    """AGG-1 (+ WIN-4, AGG-4 per line): surprisal in bits of the scored labels.

    Labels at ``pos < h`` (tokens of the first half) cost 0.  Also returns the
    per-line unknown share over labels that are not the bare ``spe_id`` piece.
    """
    b = bits()
    scored = b if h_col is None else F.when(F.col("pos") >= F.col(h_col), b).otherwise(0.0)
    counted = F.lit(True) if spe_id is None else (F.col("token_id") != F.lit(spe_id))
    return token_loss.groupBy(*line_keys).agg(
        F.sum(scored).alias("surprisal"),
        F.count_if(counted & (F.col("token_id") == UNK_ID)).alias("n_unk"),
        F.count_if(counted).alias("n_counted"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def ppl_lines(lines: DataFrame, vocab: DataFrame, lm: DataFrame, mode: str = "word",
              pairs="all", max_len: int = 512, alpha: float = 0.1,
              only_second_half: bool = True, spe_id: int | None = None,
              line_keys: Sequence[str] = ("lang", "doc_id", "line_no"),
              known_entries: int | None = None, scorer=None, info: DataFrame | None = None,
              ctx: DataFrame | None = None) -> DataFrame:
    """Per-line part of JOB-8 (AGG-1, WIN-4, FN-12): one row per
    ``(vocab_lang, line)`` with ``surprisal`` (bits of the second half),
    ``n_unk`` / ``n_counted`` (unknown share terms over the whole truncated
    line), ``nbytes`` (bytes of the scored half) and ``truncated``.

    Ids are ``[prepend] + tokens`` cut to ``max_len``; labels are the tokens.
    Blank lines must be filtered by the caller.
    """
    keys = list(line_keys)
    body = lines.select(
        *keys, "line", first_half("line").alias("__half"),
        byte_len(second_half("line") if only_second_half else F.col("line")).alias("nbytes"))
    carry = ["h", "nbytes", "truncated"]
    if mode == "word":
        # token counts of the line and of its first half need no vocabulary
        body = (body.withColumn("h", F.size(words_col("__half")) if only_second_half else F.lit(0))
                .withColumn("truncated", (F.size(words_col("line")) + 1 > max_len).cast("int")))
        rows = label_rows_for(body, vocab, mode, pairs, keys, carry, known_entries, max_len - 1,
                              info=info)
    else:
        full = encode(body, vocab, mode, pairs, keys, known_entries=known_entries,
                      carry=["nbytes"], info=info)
        half = encode(body.select(*keys, F.col("__half").alias("line")), vocab, mode, pairs, keys,
                      known_entries=known_entries, out="__hids", info=info)
        full = (full.join(half, ["vocab_lang", *keys])
                .withColumn("h", F.size("__hids") if only_second_half else F.lit(0))
                .withColumn("truncated", (F.size("ids") + 1 > max_len).cast("int"))
                .withColumn("ids", F.slice("ids", 1, max_len - 1)))
        rows = lm_ops.label_rows(full, ["vocab_lang", *keys, *carry])
    rows = rows.join(_sizes(vocab, info), "vocab_lang")
    tl = _scored(rows, lm, alpha, scorer, ctx)
    return line_surprisal(tl, ["vocab_lang", *keys, *carry, "V"], "h", spe_id)


def evaluate_ppl(lines: DataFrame, vocab: DataFrame, lm: DataFrame, mode: str = "word",
                 pairs="all", max_len: int = 512, alpha: float = 0.1,
                 only_second_half: bool = True, spe_id: int | None = None,
                 line_keys: Sequence[str] = ("lang", "doc_id", "line_no"),
                 known_entries: int | None = None, scorer=None, info: DataFrame | None = None,
                 ctx: DataFrame | None = None) -> DataFrame:
    """JOB-8: per ``(vocab_lang, lang)``: ``log_ppl`` (AGG-2, mean total bits per
    line), ``norm_ppl`` (AGG-3, mean of per-line bits/byte), ``uid_prop``
    (AGG-4, mean of per-line unknown shares), line counts.

    Blank lines are filtered and counted (``n_blank``) instead of dividing by
    zero.  A truncated line still divides by the bytes of its whole second half.
    """
    blank = is_blank("line")
    n_blank = lines.filter(blank).groupBy("lang").agg(F.count(F.lit(1)).alias("n_blank"))
    per_line = ppl_lines(lines.filter(~blank), vocab, lm, mode, pairs, max_len, alpha,
                         only_second_half, spe_id, line_keys, known_entries, scorer, info, ctx)
    per_model = per_line.groupBy("vocab_lang", "lang").agg(
        F.avg("surprisal").alias("log_ppl"),
        F.avg(F.col("surprisal") / F.col("nbytes")).alias("norm_ppl"),
        F.avg(F.try_divide("n_unk", "n_counted")).alias("uid_prop"),
        F.count(F.lit(1)).cast("long").alias("n_lines"),
        F.sum("truncated").cast("long").alias("n_truncated"),
    )
    return (per_model.join(F.broadcast(n_blank), "lang", "left")
            .withColumn("n_blank", F.coalesce(F.col("n_blank"), F.lit(0)).cast("long")))


def bytes_per_token(lines: DataFrame, pieces: DataFrame, pairs="all", n_special: int = 2,
                    info: DataFrame | None = None) -> DataFrame:
    """AGG-5: total bytes / total tokens (ratio of sums) under every vocabulary's
    greedy tokenizer; ``n_special`` ids (e.g. cls + sep) are counted for every line.

    Words are counted by language before they meet a vocabulary, so neither the
    lines nor the words' occurrences are repeated for each vocabulary.
    """
    words = cut_lineage(counted_words(lines), "words").withColumnRenamed("token", "word")  # read twice
    sizes = lines.groupBy("lang").agg(F.sum(byte_len("line")).cast("long").alias("n_bytes"),
                                      F.count(F.lit(1)).alias("n_lines"))
    grid = with_vocab_langs(words, pieces, pairs, info).select("vocab_lang", "lang", "word", "n")
    found = greedy_pieces(grid.select("vocab_lang", "word"), pieces).select(
        "vocab_lang", "word", F.size("ids").alias("k"))
    tokens = grid.join(found, ["vocab_lang", "word"]).groupBy("vocab_lang", "lang").agg(
        F.sum(F.col("n") * F.col("k")).alias("n_pieces"))
    cells = with_vocab_langs(sizes, pieces, pairs, info)  # one row a cell
    total = (F.coalesce("n_pieces", F.lit(0)) + F.lit(n_special) * F.col("n_lines")).cast("long")
    return (cells.join(F.broadcast(tokens), ["vocab_lang", "lang"], "left")
            .select("vocab_lang", "lang", F.try_divide("n_bytes", total).alias("bpt"), "n_bytes",
                    total.alias("n_tokens")))


def option_prompts(mcq: DataFrame) -> DataFrame:
    """FN-6: one prompt per (item, option): passage, question, answer, stripped
    and joined by spaces.  ``opt`` is 0-based."""
    return mcq.select("item_id", "correct", F.posexplode("answers").alias("opt", "answer"),
                      "passage", "question").select(
        "item_id", "correct", "opt",
        join_prompt("passage", "question", "answer").alias("line"))


def evaluate_mcq(mcq: DataFrame, vocab: DataFrame, lm: DataFrame, mode: str = "word",
                 max_len: int = 512, alpha: float = 0.1, known_entries: int | None = None,
                 scorer=None, info: DataFrame | None = None,
                 ctx: DataFrame | None = None) -> DataFrame:
    """JOB-9 / WIN-5 / AGG-6: accuracy per model; option loss is the total in
    whole 1 / UNIT nats with no unknown penalty, so its sum has no order; the least loss
    wins, lowest index on ties."""
    prompts = option_prompts(mcq).withColumn("lang", F.lit("mcq"))
    rows = label_rows_for(prompts, vocab, mode, "all", ["item_id", "opt"], ["correct"],
                          known_entries, max_len - 1, info=info)
    rows = rows.join(_sizes(vocab, info), "vocab_lang")
    tl = _scored(rows, lm, alpha, scorer, ctx)
    opt_loss = tl.groupBy("vocab_lang", "item_id", "correct", "opt").agg(
        F.sum(lm_ops.whole(F.col("loss_nats"))).alias("loss"))
    picked = opt_loss.groupBy("vocab_lang", "item_id", "correct").agg(
        F.min_by("opt", F.struct("loss", "opt")).alias("pred"))
    return picked.groupBy("vocab_lang").agg(
        F.avg(((F.col("pred") + 1) == F.col("correct")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("long").alias("n_items"))


def evaluate_min_pairs(pairs_df: DataFrame, vocab: DataFrame, lm: DataFrame,
                       mode: str = "word", max_length: int | None = 50, alpha: float = 0.1,
                       pair_keys: Sequence[str] = ("doc_id", "line_no"),
                       known_entries: int | None = None, scorer=None,
                       info: DataFrame | None = None,
                       ctx: DataFrame | None = None, pairs="all") -> DataFrame:
    """JOB-10 / AGG-7: share of pairs with ``wrong_nll - sen_nll > 0`` (strict).

    Each side is scored from the prepended id on, in whole 1 / UNIT nats: sums
    have no order, so two sides with the same losses (e.g. all-unknown lines)
    tie exactly.  A pair where either side has ``>= max_length`` tokens counts
    as incorrect.
    """
    pair_keys = list(pair_keys)
    sides = pairs_df.select("lang", *pair_keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("sen").alias("line")),
        F.struct(F.lit(1).alias("side"), F.col("wrong_sen").alias("line")))).alias("s")
    ).select("lang", *pair_keys, "s.side", "s.line")
    keys = ["lang", *pair_keys, "side"]
    rows = label_rows_for(sides, vocab, mode, pairs, keys, (), known_entries, info=info)
    rows = rows.join(_sizes(vocab, info), "vocab_lang")
    tl = _scored(rows, lm, alpha, scorer, ctx)
    # one pass: per pair, the two side totals and lengths from the label rows
    side, cost = F.col("side"), lm_ops.whole(F.col("loss_nats"))
    per_pair = tl.groupBy("vocab_lang", "lang", *pair_keys).agg(
        F.sum(F.when(side == 1, cost).otherwise(-cost)).alias("delta"),
        F.count_if(side == 0).alias("sen_len"), F.count_if(side == 1).alias("wrong_len"))
    over = (F.lit(False) if max_length is None else
            (F.col("sen_len") >= max_length) | (F.col("wrong_len") >= max_length))
    return per_pair.groupBy("vocab_lang", "lang").agg(
        F.avg((~over & (F.col("delta") > 0)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("long").alias("n_pairs"),
        F.sum(over.cast("int")).cast("long").alias("n_over"))
