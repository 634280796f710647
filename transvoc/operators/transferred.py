"""Models carried over to another vocabulary, and their scores (JOB-11).

A count model has a row of statistics for each token, as a neural model has a
row of its embedding matrix.  A transferred model speaks the target vocabulary;
the row of each of its tokens is a weighted sum of source rows
(:func:`transferred_weights`): the token itself where both vocabularies have it,
the mean of its source pieces (FVT), or its anchors by their coefficients (OMP).
As a bigram has two tokens, the counts of the transferred model are the sparse
product ``W C W'`` of the weights with the source's counts, and its context counts
``W n``.  Coefficients can be negative: a count is cut to lie between 0 and its
context's.

Fine-tuning a count model adds the counts of the tuning text under the model's
vocabulary.  So every model is a sum of *parts* (:func:`model_plan`), and the counts
of all models for the bigrams that the held-out text has come from one table of
parts (:func:`part_counts`).

All held-out lines are read and split once (:func:`label_counts`); a line keeps each of its
bigrams with how often it occurs, so the commonest, two unknown words, is one entry a line.  Losses
are computed per distinct bigram, for all models in one row (:func:`model_losses`).  Lines are scored in
blocks (:func:`score_lines`): a block gets each of its distinct bigrams once and multiplies its
lines with the losses of all models, so no row a line, bigram and model is ever shuffled; the bigrams that
most lines have are measured and broadcast, the others are shuffled.  Losses are summed as
whole numbers (:data:`UNIT`), so sums don't depend on their order and equal sentences tie exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transvoc.functions.text import byte_len, first_half, second_half
from transvoc.operators.lm import UNIT, context_counts, whole  # noqa: F401 - whole: for callers that make losses
from transvoc.operators.product import sampled_product
from transvoc.operators.report import REGIMES
from transvoc.operators.tokenize import (MAX_BROADCAST_ENTRIES, encode_long, read_shared, read_vocabularies, token_rows,
                                         with_vocab_langs, words_col, write_vocabularies)
from transvoc.operators.transfer import pair_tokens
from transvoc.operators.trie import greedy_pieces
from transvoc.operators.vocab import CLS_ID, COUNT_WORDS, UNK_ID, word_portions
from transvoc.session import scratch_path

PAIR = ["src_lang", "tgt_lang"]
MOVED = [*PAIR, "method"]
#: Bigrams that are broadcast at most, the most frequent ones, and lines that each must have.
HEAVY_KEYS, HEAVY_LINES = 1000, 1000
#: Bigrams of lines in a block that is scored at once, about, and those whose losses are summed at a time.
BLOCK_LABELS, SUMMED_LABELS = 1_000_000, 8192
#: What a line keeps of each of its bigrams, and what identifies a line under a vocabulary.
COUNTED = ["prev_id", "token_id", "n_scored", "n_read", "n_sen", "n_wrong"]
LINE = ["vocab_lang", "lang", "doc_id", "line_no", "nbytes"]


def transferred_weights(vocab: DataFrame, pieces: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``(src_lang, tgt_lang, method, id, sid, w)``: what each target id takes from which source ids.
    ``rebuilt`` is the output of OMP.  The unknown id and the one before a line stand for themselves."""
    shared, missing = pair_tokens(vocab)
    both = F.explode(F.array(F.lit("fvt"), F.lit("omp"))).alias("method")
    copied = shared.select(*PAIR, both, F.col("tgt_id").alias("id"), F.col("src_id").alias("sid"), F.lit(1.0).alias("w"))
    words = missing.select(*PAIR, "tgt_id", F.col("src_lang").alias("vocab_lang"), F.col("token").alias("word"))
    found = greedy_pieces(words.select("vocab_lang", "word"), pieces)
    meaned = (words.join(found, ["vocab_lang", "word"])
              .select(*PAIR, F.col("tgt_id").alias("id"), F.size("ids").alias("k"), F.explode("ids").alias("sid"))
              .groupBy(*PAIR, "id", "k", "sid").agg(F.count(F.lit(1)).alias("n"))
              .select(*PAIR, F.lit("fvt").alias("method"), "id", "sid", (F.col("n") / F.col("k")).alias("w")))
    chosen = (rebuilt.select(*PAIR, F.col("tgt_id").alias("id"), F.explode(F.arrays_zip(
                  F.col("support").alias("token"), F.col("coefs").alias("w"))).alias("z"))
              .select(*PAIR, "id", "z.token", "z.w"))
    anchored = (chosen.join(shared.select(*PAIR, "token", F.col("src_id").alias("sid")), [*PAIR, "token"])
                .select(*PAIR, F.lit("omp").alias("method"), "id", "sid", "w"))
    langs = vocab.select(F.col("lang").alias("src_lang")).distinct()
    own = F.explode(F.array(F.lit(UNK_ID), F.lit(CLS_ID)))
    special = (langs.join(F.broadcast(langs.toDF("tgt_lang")), F.col("src_lang") != F.col("tgt_lang"))  # languages
               .select(*PAIR, both, own.alias("id")).withColumns({"sid": F.col("id"), "w": F.lit(1.0)}))
    return copied.unionByName(meaned).unionByName(anchored).unionByName(special)


def transferred_counts(weights: DataFrame, lm: DataFrame, need: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts ``(.., prev_id, token_id, c)`` and context counts ``(.., prev_id, n)`` of every transferred model for
    the bigrams ``need (vocab_lang, prev_id, token_id)``."""
    need = need.withColumnRenamed("vocab_lang", "tgt_lang")
    entries = weights.select(*MOVED, F.col("id").alias("row"), F.col("sid").alias("col"), "w")
    taken = weights.select(*MOVED, F.col("sid").alias("col")).distinct()
    counts = (lm.select(F.col("lang").alias("src_lang"), F.col("prev").alias("a"), F.col("tok").alias("b"), "n")
              .join(taken.withColumnRenamed("col", "a"), ["src_lang", "a"])
              .join(taken.withColumnRenamed("col", "b"), [*MOVED, "b"], "left_semi"))
    models = weights.select(*MOVED).distinct()
    wanted = need.join(F.broadcast(models), "tgt_lang").select(  # one row a model
        *MOVED, F.col("prev_id").alias("p"), F.col("token_id").alias("t"))
    product = sampled_product(entries, counts, wanted, MOVED)
    first = weights.join(need.select("tgt_lang", F.col("prev_id").alias("id")).distinct(), ["tgt_lang", "id"], "left_semi")
    contexts = (first.join(context_counts(lm).select(F.col("lang").alias("src_lang"), F.col("prev").alias("sid"), "n_prev"),
                           ["src_lang", "sid"])
                .groupBy(*MOVED, F.col("id").alias("prev_id"))
                .agg(F.greatest(F.sum(F.col("w") * F.col("n_prev")), F.lit(0.0)).alias("n")))
    rows = contexts.select(*MOVED, F.col("prev_id").cast("long").alias("p"), "n")
    kept = product.join(rows, [*MOVED, "p"])  # the product is dealt by its rows: it is not shuffled again
    return kept.select(*MOVED, F.col("p").cast("int").alias("prev_id"), F.col("t").cast("int").alias("token_id"),
                       F.least(F.greatest("c", F.lit(0.0)), F.col("n")).alias("c")), contexts


def text_counts(lines: DataFrame, vocab: DataFrame, known_entries: int | None = None,
                info: DataFrame | None = None) -> DataFrame:
    """``(vocab_lang, lang, prev, tok, n)``: bigram counts of the lines of every language under every vocabulary.

    Words get one number for all vocabularies (null: in none of them), and pairs of these are counted before they meet
    a vocabulary, so the corpus is split and looked up once, whatever the number of vocabularies."""
    small = F.broadcast if known_entries is not None and known_entries <= MAX_BROADCAST_ENTRIES else lambda df: df
    # written once, so that the numbers stay the same
    path = scratch_path(lines.sparkSession, "words")
    vocab.select("token").distinct().withColumn("word", F.monotonically_increasing_id()).write.parquet(path)
    words = lines.sparkSession.read.parquet(path)
    if known_entries is not None and known_entries <= MAX_BROADCAST_ENTRIES:
        pairs = _counted_pairs(lines, path)
    else:
        rows = (token_rows(lines, ["lang"])
                .join(words, "token", "left").join(words.toDF("prev_token", "before"), "prev_token", "left")
                .withColumn("before", F.when(F.col("pos") == 0, F.lit(-1)).otherwise(F.col("before"))))
        pairs = rows.groupBy("lang", "before", "word").agg(F.count(F.lit(1)).alias("n"))
    ids = vocab.select(F.col("lang").alias("vocab_lang"), "token", F.col("id").cast("int").alias("id")).join(small(words), "token")
    own = lambda word, out: small(ids.select("vocab_lang", F.col("word").alias(word), F.col("id").alias(out)))
    unknown = F.lit(UNK_ID)
    found = (with_vocab_langs(pairs, vocab, "all", info)
             .join(own("before", "p"), ["vocab_lang", "before"], "left").join(own("word", "t"), ["vocab_lang", "word"], "left"))
    prev = F.when(F.col("before") == -1, F.lit(CLS_ID)).otherwise(F.coalesce("p", unknown))
    return found.groupBy("vocab_lang", "lang", prev.alias("prev"), F.coalesce("t", unknown).alias("tok")).agg(F.sum("n").alias("n"))


def _counted_pairs(lines: DataFrame, path: str) -> DataFrame:
    """``(lang, before, word, n)``: pairs of the numbers that words have in the table ``(token, word)`` at ``path``, null if
    none, -1 before a line; counted in Arrow batches before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_shared(path)
        tokens, size = table.column("token").combine_chunks(), len(table)
        numbers = pa.concat_arrays([table.column("word").combine_chunks(), pa.array([None, -1], pa.int64())])
        for langs, sizes, words in word_portions(batches):
            word = pc.fill_null(pc.index_in(words, value_set=tokens), size).to_numpy().astype(np.int64)
            before = np.roll(word, 1)
            before[np.cumsum(sizes) - sizes] = size + 1
            lang = langs.dictionary_encode(null_encoding="encode")
            codes = (np.repeat(lang.indices.to_numpy().astype(np.int64), sizes) * (size + 2) + before) * (size + 2) + word
            keys, n = np.unique(codes, return_counts=True)
            rest, word = np.divmod(keys, size + 2)
            rows, k = np.unique(rest, return_counts=True)  # a row a language and word before, with lists of what follows
            of, before = np.divmod(rows, size + 2)
            ends = pa.array(np.concatenate(([0], np.cumsum(k))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(of)), numbers.take(pa.array(before)),
                 pa.ListArray.from_arrays(ends, numbers.take(pa.array(word))),
                 pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))], ["lang", "before", "words", "ns"])

    kind = lines.schema["lang"].dataType.simpleString()
    counted = lines.select("lang", "line").mapInArrow(run, f"lang {kind}, before bigint, words array<bigint>, ns array<bigint>")
    return (counted.select("lang", "before", F.explode(F.arrays_zip("words", "ns")).alias("z"))
            .groupBy("lang", "before", F.col("z.words").alias("word")).agg(F.sum("z.ns").alias("n")))


def part_counts(weights: DataFrame, lm_all: DataFrame, need: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vocab_lang, part, prev_id, token_id, c)`` and ``(vocab_lang, part, prev_id, n)``: the counts of every part.
    A part is a language, whose text is counted under the vocabulary, or ``method:source``."""
    own = lm_all.where("vocab_lang = lang").select("lang", "prev", "tok", "n")
    moved, contexts = transferred_counts(weights, own, need)
    name = F.concat_ws(":", "method", "src_lang").alias("part")
    text = lm_all.select("vocab_lang", F.col("lang").alias("part"), F.col("prev").alias("prev_id"),
                         F.col("tok").alias("token_id"), F.col("n").cast("double").alias("c"))
    found = need.join(text, ["vocab_lang", "prev_id", "token_id"]).select(
        "vocab_lang", "part", "prev_id", "token_id", "c")
    counts = found.unionByName(moved.select(F.col("tgt_lang").alias("vocab_lang"), name, "prev_id", "token_id", "c"))
    before = text.groupBy("vocab_lang", "part", "prev_id").agg(F.sum("c").alias("n"))
    return counts, before.unionByName(contexts.select(F.col("tgt_lang").alias("vocab_lang"), name, "prev_id", "n"))


def model_plan(langs: DataFrame) -> DataFrame:
    """``(regime, src_lang, tgt_lang, label, vocab_lang, parts, model)``: the model of every cell of the metric matrix,
    one row per ordered pair of ``langs (lang)``, label and regime.

    A source baseline and a transferred model are tuned on the target's text, in the mixed regime on the
    source's too; the target baseline never is.  Cells with the same parts share a model."""
    spark = langs.sparkSession
    regimes = spark.createDataFrame([(r,) for r in REGIMES], "regime string")
    labels = spark.createDataFrame([("100mb_src",), ("10mb_tgt",), ("fvt",), ("omp",)], "label string")
    src, tgt = langs.select(F.col("lang").alias("src_lang")), langs.select(F.col("lang").alias("tgt_lang"))
    cells = (src.join(F.broadcast(tgt), F.col("src_lang") != F.col("tgt_lang"))  # languages squared
             .crossJoin(F.broadcast(regimes)).crossJoin(F.broadcast(labels)))
    tuned = (F.when((F.col("label") == "10mb_tgt") | (F.col("regime") == REGIMES[0]), F.array().cast("array<string>"))
             .when(F.col("regime") == REGIMES[1], F.array("tgt_lang")).otherwise(F.array("src_lang", "tgt_lang")))
    base = (F.when(F.col("label") == "100mb_src", F.col("src_lang")).when(F.col("label") == "10mb_tgt", F.col("tgt_lang"))
            .otherwise(F.concat_ws(":", "label", "src_lang")))
    vocab = F.when(F.col("label") == "100mb_src", F.col("src_lang")).otherwise(F.col("tgt_lang"))
    cells = cells.withColumns({"vocab_lang": vocab, "parts": F.concat(F.array(base), tuned)})
    return cells.withColumn("model", F.concat(F.col("vocab_lang"), F.lit("|"), F.array_join("parts", "+")))


def label_counts(lines: DataFrame, vocab: DataFrame, max_len: int, known_entries: int | None = None,
                 info: DataFrame | None = None) -> DataFrame:
    """Every non-blank line under every vocabulary: one row per bigram of the line or of its words in reverse order.

    ``(vocab_lang, lang, doc_id, line_no, nbytes, prev_id, token_id, n_scored, n_read, n_sen, n_wrong)``: how often it
    occurs among the scored labels (second half, within ``max_len`` ids), among the labels within ``max_len``, in the line, and in the
    reversed line; ``nbytes`` are those of the second half."""
    return unpacked_lines(counted_lines(lines, vocab, max_len, known_entries, info))


def counted_lines(lines: DataFrame, vocab: DataFrame, max_len: int, known_entries: int | None = None,
                  info: DataFrame | None = None) -> DataFrame:
    """:func:`label_counts` in packed form (:func:`packed_lines`).

    A line's words are looked up once for all vocabularies and its bigrams counted in Arrow batches; the workers read
    the vocabularies from the shared folder.  Beyond ``MAX_BROADCAST_ENTRIES`` entries, or without ``known_entries``, words
    join them instead."""
    spark = lines.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = lines.repartition(n, "lang", "doc_id", "line_no")  # what follows is grouped by line: no shuffle of bigrams
    if known_entries is None or known_entries > MAX_BROADCAST_ENTRIES:
        return packed_lines(_joined_label_counts(lines, vocab, max_len, known_entries, info))
    path = write_vocabularies(vocab)
    body = lines.withColumn("half", first_half("line")).select(
        *LINE[1:4], byte_len(second_half("line")).alias("nbytes"), F.size(words_col("half")).alias("h"), "line").where(
        F.col("line") != "")
    texts = body.groupBy(*LINE[1:]).agg(F.collect_list(F.struct("h", "line")).alias("texts"))  # lines with one key count as one
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join(["vocab_lang string", *(f"`{c}` {kinds[c]}" for c in LINE[1:]), *(f"{c} array<int>" for c in COUNTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tokens, ids = read_vocabularies(path)
        for batch in batches:
            for lang, rows, lists in _count_batch(batch.column("texts"), tokens, ids[:-1], langs, max_len):
                keys = [batch.column(c).take(rows) for c in LINE[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *keys, *lists], [*LINE, *COUNTED])

    return texts.mapInArrow(run, schema)


def _count_batch(texts: pa.ListArray, tokens: pa.Array, ids: np.ndarray, langs: list[str],
                 max_len: int) -> Iterator[tuple[str, pa.Array, list[pa.ListArray]]]:
    """For each vocabulary its language, the rows that have bigrams, and their ``COUNTED`` lists."""
    items = texts.flatten()
    words = pc.split_pattern(pc.struct_field(items, "line"), " ")
    sizes = pc.list_value_length(words).to_numpy()
    found = pc.fill_null(pc.index_in(words.flatten(), value_set=tokens), len(tokens)).to_numpy()
    ends = np.cumsum(sizes)
    pos = np.arange(len(found)) - np.repeat(ends - sizes, sizes)
    last = pos == np.repeat(sizes, sizes) - 1
    row = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy()), sizes)
    read = pos < max_len - 1
    scored = read & (pos >= np.repeat(pc.struct_field(items, "h").to_numpy(), sizes))
    width = int(max(ids.max(initial=0), CLS_ID)) + 1
    role = np.where(scored, 0, np.where(read, 1, 2))  # of a word in its line; 3: in the reversed line
    for lang, own in zip(langs, ids, strict=True):
        tok = own[found].astype(np.int64)
        prev = np.where(pos == 0, CLS_ID, np.roll(tok, 1))
        after = np.where(last, CLS_ID, np.roll(tok, -1))  # what comes before it in the reversed line
        code = lambda p, tok=tok: (row * width + p) * width + tok
        found_at = np.sort(np.concatenate((code(prev) * 4 + role, code(after) * 4 + 3)))
        first = np.flatnonzero(np.diff(found_at >> 2, prepend=-1))
        keys, at = found_at[first] >> 2, np.repeat(np.arange(len(first)), np.diff(first, append=len(found_at)))
        n = np.bincount(at * 4 + (found_at & 3), minlength=4 * len(keys)).reshape(-1, 4)
        values = [keys // width % width, keys % width, n[:, 0], n[:, 0] + n[:, 1], n[:, :3].sum(axis=1), n[:, 3]]
        of, k = np.unique(keys // width ** 2, return_counts=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum(k))).astype(np.int32))
        yield lang, pa.array(of), [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in values]


def _joined_label_counts(lines: DataFrame, vocab: DataFrame, max_len: int, known_entries: int | None,
                         info: DataFrame | None) -> DataFrame:
    """:func:`label_counts` by joins, for vocabularies of any size."""
    ws = words_col("line")
    sides = lines.withColumn("half", first_half("line")).select(
        "lang", "doc_id", "line_no", byte_len(second_half("line")).alias("nbytes"),
        F.size(words_col("half")).alias("h"), F.explode(F.array(
            F.struct(F.lit(0).alias("side"), ws.alias("ws")), F.struct(F.lit(1).alias("side"), F.reverse(ws).alias("ws")))).alias("s"))
    keys = ["lang", "doc_id", "line_no", "nbytes", "h", "side"]
    texts = sides.select(*keys[:-1], "s.side", F.array_join("s.ws", " ").alias("line"))
    rows = encode_long(texts, vocab, "all", keys, known_entries=known_entries, info=info)
    read = (F.col("side") == 0) & (F.col("pos") < max_len - 1)
    return rows.groupBy("vocab_lang", "lang", "doc_id", "line_no", "nbytes", "prev_id", "token_id").agg(
        F.count_if(read & (F.col("pos") >= F.col("h"))).alias("n_scored"), F.count_if(read).alias("n_read"),
        F.count_if(F.col("side") == 0).alias("n_sen"), F.count_if(F.col("side") == 1).alias("n_wrong"))


def packed_lines(labels: DataFrame) -> DataFrame:
    """One row a line and vocabulary, its bigrams and their counts (``COUNTED``) in parallel lists."""
    if dict(labels.dtypes)["prev_id"].startswith("array"):
        return labels
    return labels.groupBy(*LINE).agg(*(F.collect_list(F.col(c).cast("int")).alias(c) for c in COUNTED))


def unpacked_lines(lines: DataFrame) -> DataFrame:
    """The rows of :func:`label_counts` again."""
    zipped = F.explode(F.arrays_zip(*COUNTED)).alias("z")
    return lines.select(*LINE, zipped).select(*LINE, *(F.col(f"z.{c}") for c in COUNTED))


def model_losses(seen: DataFrame, plan: DataFrame, counts: DataFrame, contexts: DataFrame, sizes: DataFrame,
                 alpha: float) -> DataFrame:
    """``(vocab_lang, lang, prev_id, token_id, V, models, q)``: the add-alpha losses of each bigram ``seen`` in a language,
    under every model that is scored on it, in 1 / UNIT nats.  ``models`` is the same list for all bigrams of a
    vocabulary and language; the counts of a bigram's parts stand in one row, too."""
    parts = (plan.select("model", "vocab_lang", "parts").distinct())
    on = (plan.select("model", "vocab_lang", F.explode(F.array("src_lang", "tgt_lang")).alias("lang")).distinct()
          .join(parts, ["model", "vocab_lang"]).groupBy("vocab_lang", "lang")
          .agg(F.array_sort(F.collect_list(F.struct("model", "parts"))).alias("m")).join(sizes, "vocab_lang"))
    spark, keys = seen.sparkSession, ["vocab_lang", "lang"]
    known = on.select(*keys, "V", F.col("m.model").alias("models"), F.col("m.parts").alias("parts")).collect()  # languages squared
    of = {(r["vocab_lang"], r["lang"]): (r["V"], r["parts"]) for r in known}
    names = spark.createDataFrame([(r["vocab_lang"], r["lang"], r["V"], r["models"]) for r in known],
                                  "vocab_lang string, lang string, V double, models array<string>")
    listed = lambda v: F.collect_list(F.struct("part", F.col(v).alias("x"))).alias(v)
    bigram = ["vocab_lang", "prev_id", "token_id"]  # one shuffle for both sums, the lists and the join
    c = (counts.repartition(*bigram).groupBy(*bigram, "part").agg(F.sum("c").alias("c"))
         .groupBy(*bigram).agg(listed("c")))
    n = (contexts.groupBy("vocab_lang", "prev_id", "part").agg(F.sum("n").alias("n"))
         .groupBy("vocab_lang", "prev_id").agg(listed("n")))
    entries = sum({v: size for (v, _), (size, _) in of.items()}.values())
    if entries * len({p for _, models in of.values() for m in models for p in m}) <= MAX_BROADCAST_ENTRIES:
        n = F.broadcast(n)  # a row a vocabulary entry at most, with all parts
    rows = (seen.select(*keys, "prev_id", "token_id").join(F.broadcast(names.select(*keys)), keys, "left_semi")
            .join(c, bigram, "left").join(n, ["vocab_lang", "prev_id"], "left"))
    rows = rows.select(*keys, "prev_id", "token_id", "c", "n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            for v, lang in sorted(set(zip(*pair, strict=True))):
                here = pa.array(np.flatnonzero((pair[0] == v) & (pair[1] == lang)))
                some = batch.take(here)
                q = _losses(some.column("c"), some.column("n"), *of[v, lang], alpha)
                ends = pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:4], pa.ListArray.from_arrays(ends, pa.array(q.ravel()))], [*some.schema.names[:4], "q"])

    found = rows.mapInArrow(run, f"{kinds}, q array<bigint>")
    return found.join(F.broadcast(names), keys).select(*keys, "prev_id", "token_id", "V", "models", "q")


def _losses(c: pa.ListArray, n: pa.ListArray, size: float, models: list[list[str]], alpha: float) -> np.ndarray:
    """Losses in 1 / UNIT nats, a row a bigram, a column a model; a model's parts are added up in their order."""
    def by_part(lists: pa.ListArray) -> dict[str, np.ndarray]:
        items = lists.flatten()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        part, x = pc.struct_field(items, "part").dictionary_encode(), pc.struct_field(items, "x").to_numpy(zero_copy_only=False)
        out = {}
        for i, name in enumerate(part.dictionary.to_pylist()):
            at = part.indices.to_numpy(zero_copy_only=False) == i
            out[name] = np.zeros(len(lists))
            out[name][row[at]] = x[at]
        return out

    c, n, none = by_part(c), by_part(n), np.zeros(len(c))
    q = np.empty((len(none), len(models)), np.int64)
    for m, parts in enumerate(models):
        top, below = none, none
        for part in parts:
            top, below = top + c.get(part, none), below + n.get(part, none)
        nats = -np.log((top + alpha) / (below + alpha * size)) * UNIT
        q[:, m] = np.copysign(np.floor(np.abs(nats) + 0.5), nats)
    return q


def _score_block(lines: pa.Table, losses: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``known`` and ``delta`` (a row a line, a column a model) of a block's lines, and which lines have any loss."""
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    code = lambda t, p: (p.astype(np.int64) << 32) | t.astype(np.int64)
    q = flat(losses, "q").reshape(losses.num_rows, -1)
    keys = code(losses.column("token_id").to_numpy(), losses.column("prev_id").to_numpy())
    order = np.argsort(keys)
    keys = keys[order]
    token = flat(lines, "token_id")
    wanted = code(token, flat(lines, "prev_id"))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    has = keys[at] == wanted
    of = np.repeat(np.arange(lines.num_rows), np.asarray(lines.column("k")))[has]
    row, token = order[at[has]], token[has]
    scored = np.where(token == UNK_ID, 0, flat(lines, "n_scored")[has]).astype(np.int64)
    more = (flat(lines, "n_wrong")[has] - flat(lines, "n_sen")[has]).astype(np.int64)
    known, delta = (np.zeros((lines.num_rows, q.shape[1]), np.int64) for _ in range(2))
    for out, factor in ((known, scored), (delta, more)):
        used = np.flatnonzero(factor)  # most bigrams are as frequent in the reversed line
        for start in range(0, len(used), SUMMED_LABELS):
            some = used[start:start + SUMMED_LABELS]
            first = np.flatnonzero(np.diff(of[some], prepend=-1))  # a line's bigrams stand together
            out[of[some][first]] += np.add.reduceat(factor[some, None] * q[row[some]], first, axis=0)
    return known, delta, np.bincount(of, minlength=lines.num_rows) > 0


def _line_sums(lines: pa.Table) -> list[np.ndarray]:
    """Of each line: its scored unknown labels, its unknown labels and its labels among the read ones, all its labels."""
    flat = lambda c: lines.column(c).combine_chunks().flatten().to_numpy()
    of, unknown = np.repeat(np.arange(lines.num_rows), np.asarray(lines.column("k"))), flat("token_id") == UNK_ID
    counts = (flat("n_scored") * unknown, flat("n_read") * unknown, flat("n_read"), flat("n_sen"))
    return [np.bincount(of, weights=n, minlength=lines.num_rows).astype(np.int64) for n in counts]


def score_lines(labels: DataFrame, losses: DataFrame, heavy: DataFrame, max_pair_len: int,
                block_labels: int = BLOCK_LABELS) -> DataFrame:
    """``(model, lang, doc_id, line_no, surprisal, nbytes, n_unk, n_read, delta, over)`` of every line under every model.

    ``surprisal`` in bits: an unknown label costs log2(V) whatever the model says; ``delta``: by how much the
    reversed line costs more, in 1 / UNIT nats.  ``labels`` may be packed already (:func:`packed_lines`).  Lines are
    dealt into blocks by their counted bigrams; a block gets the losses of its distinct bigrams, and those of all of ``heavy``."""
    pair, key = ["vocab_lang", "lang"], ["vocab_lang", "lang", "prev_id", "token_id"]
    if "models" not in losses.columns:
        losses = (losses.groupBy(*key, "V").agg(F.array_sort(F.collect_list(F.struct("model", "q"))).alias("m"))
                  .select(*key, "V", F.col("m.model").alias("models"), F.col("m.q").alias("q")))
    lines = packed_lines(labels)
    lines = lines.withColumn("k", F.size("prev_id"))
    blocks = lines.groupBy(*pair).agg(F.ceil(F.sum("k") / F.lit(block_labels)).alias("blocks"))
    dealt = (lines.join(F.broadcast(blocks), pair)  # languages squared
             .withColumn("block", F.pmod(F.xxhash64("doc_id", "line_no", "nbytes"), F.col("blocks"))).drop("blocks"))
    table = losses.select(*key, "q")
    most = (blocks.select(*pair, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
            .join(F.broadcast(table.join(F.broadcast(heavy), key, "left_semi")), pair))  # every block gets them
    met = dealt.select(*pair, "block", F.explode(F.arrays_zip("prev_id", "token_id")).alias("z")).select(
        *pair, "block", "z.prev_id", "z.token_id")
    rest = met.join(F.broadcast(heavy), key, "left_anti").distinct().join(table, key)
    own = dealt.select(*pair, "block", *LINE[2:], "k", *COUNTED)
    out = [*pair, *LINE[2:]]
    summed = ["unknown", "n_unk", "n_read", "n_sen"]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if found.num_rows and block.num_rows:
            known, delta, scored = _score_block(block, found)
        else:
            known = delta = np.zeros((block.num_rows, 0), np.int64)
            scored = np.zeros(block.num_rows, bool)
        width = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * known.shape[1])
        lists = {n: pa.ListArray.from_arrays(width, pa.array(np.ascontiguousarray(x).ravel()))
                 for n, x in (("known", known), ("delta", delta))}
        sums = {n: pa.array(x) for n, x in zip(summed, _line_sums(block), strict=True)}
        return pa.table({c: block.column(c) for c in out} | sums | lists).filter(pa.array(scored))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in out), *(f"{c} bigint" for c in summed),
                        "known array<bigint>, delta array<bigint>"])
    right = most.unionByName(rest).select(*pair, "block", "prev_id", "token_id", "q")
    keys = [*pair, "block"]
    scored = (own.groupBy(*keys).cogroup(right.toDF(*(f"r_{c}" for c in right.columns)).toDF(*right.columns).groupBy(*keys))
              .applyInArrow(run, schema))
    names = losses.select(*pair, "V", "models").distinct()  # a row a vocabulary and language
    per_line = scored.join(F.broadcast(names), pair).select(
        *out, *summed, "V", F.explode(F.arrays_zip(F.col("models").alias("model"), "known", "delta")).alias("z"))
    bits = F.col("z.known") / F.lit(UNIT * math.log(2.0)) + F.col("unknown") * F.log2("V")
    return per_line.select("z.model", "lang", "doc_id", "line_no", bits.alias("surprisal"), "nbytes", "n_unk", "n_read",
                           "z.delta", (F.col("n_sen") >= max_pair_len).alias("over"))


def model_metrics(lines: DataFrame) -> DataFrame:
    """``(model, lang, log_ppl, norm_ppl, uid, mbp)`` from scored lines."""
    return lines.groupBy("model", "lang").agg(
        F.avg("surprisal").alias("log_ppl"), F.avg(F.col("surprisal") / F.col("nbytes")).alias("norm_ppl"),
        F.avg(F.col("n_unk") / F.col("n_read")).alias("uid"),
        F.avg((~F.col("over") & (F.col("delta") > 0)).cast("double")).alias("mbp"))


def heavy_bigrams(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct bigrams by vocabulary and language with the lines that have them, and the commonest of these."""
    seen = seen_bigrams(labels)
    return seen, commonest(seen)


def seen_bigrams(labels: DataFrame) -> DataFrame:
    """``(vocab_lang, lang, prev_id, token_id, lines)``: distinct bigrams and the lines that have them.  Those of
    packed lines (:func:`packed_lines`) are counted in Arrow batches before they are shuffled."""
    keys = ["vocab_lang", "lang"]
    if not dict(labels.dtypes)["prev_id"].startswith("array"):
        return labels.groupBy(*keys, "prev_id", "token_id").agg(F.count(F.lit(1)).alias("lines"))
    rows = labels.select(*keys, "prev_id", "token_id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-2])

    def count(part: pa.Table) -> pa.RecordBatch:
        group = np.zeros(part.num_rows, np.int64)
        for c in keys:
            value = part.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            group = group * len(value.dictionary) + value.indices.to_numpy()
        _, row, of = np.unique(group, return_index=True, return_inverse=True)
        prev, token = (part.column(c).combine_chunks() for c in ("prev_id", "token_id"))
        of = np.repeat(of, pc.list_value_length(prev).to_numpy())
        prev, token = (x.flatten().to_numpy().astype(np.int64) for x in (prev, token))
        width = int(max(prev.max(initial=0), token.max(initial=0))) + 1
        found, n = np.unique((of * width + prev) * width + token, return_counts=True)
        rest, token = np.divmod(found, width)
        of, prev = np.divmod(rest, width)
        own = [part.column(c).combine_chunks().take(pa.array(row[of])) for c in keys]
        return pa.RecordBatch.from_arrays([*own, pa.array(prev.astype(np.int32)), pa.array(token.astype(np.int32)),
                                           pa.array(n.astype(np.int64))], [*keys, "prev_id", "token_id", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("prev_id").flatten())
            if size >= COUNT_WORDS:
                yield count(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield count(pa.Table.from_batches(held))

    return (rows.mapInArrow(run, f"{kinds}, prev_id int, token_id int, lines bigint")
            .groupBy(*keys, "prev_id", "token_id").agg(F.sum("lines").alias("lines")))


def commonest(seen: DataFrame) -> DataFrame:
    """The bigrams of :func:`seen_bigrams` that most lines have: ``HEAVY_KEYS`` at most."""
    heavy = seen.where(F.col("lines") >= HEAVY_LINES).orderBy(F.col("lines").desc(), *seen.columns[:4]).limit(HEAVY_KEYS)
    return heavy.drop("lines")


def pair_cells(plan: DataFrame, per_model: DataFrame, compression: DataFrame) -> DataFrame:
    """The metric matrix: both sides of every cell of ``plan``; ``compression`` is ``(vocab_lang, lang, bpt)``."""
    values = ("log_ppl", "norm_ppl", "uid", "bpt", "mbp")
    vocab_of = plan.select("model", "vocab_lang").distinct()
    full = (per_model.join(F.broadcast(vocab_of), "model")
            .join(F.broadcast(compression.select("vocab_lang", "lang", "bpt")), ["vocab_lang", "lang"]))
    side = lambda s: full.select("model", F.col("lang").alias(f"{s}_lang"),
                                 *(F.col(v).alias(f"{s}_{'uid_prop' if v == 'uid' else v}") for v in values))
    return (plan.select("regime", *PAIR, "label", "model").join(side("src"), ["model", "src_lang"])
            .join(side("tgt"), ["model", "tgt_lang"]).drop("model"))
