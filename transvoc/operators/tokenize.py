"""Tokenization as Spark jobs (JOB-1, JN-7, SRT-5, UDF-2).

Tokens are kept in *long form* - one row per (line, position) - because every
consumer (scoring, counting, packing) works per token.  A vocabulary
``(lang, token, id)`` is attached by an equi-join on ``(vocab_lang, token)``:

* when the vocabulary is below ``max_broadcast_entries`` (it is model-sized:
  at most ``k`` rows per language, the caller passes that bound) the join is
  a broadcast *hash* join - no shuffle of the token rows at all;
* above the bound it is a plain equi-join, which Spark runs as a sort-merge
  join with AQE skew splitting (frequent tokens).

The previous token's id, which the bigram scorer needs, is resolved by a
second lookup on the previous word, so no window or regroup by line is
needed.  (Spark maps are arrays with linear key search, so ``map[...]``
lookups against a vocabulary would cost O(V) per token; joins are hashed.)

Two tokenizers: ``word`` (split on single spaces, unknown -> ``UNK_ID``) and
``greedy`` longest-match subword pieces (an unmatched character is one unknown piece), walked once per distinct
word (:mod:`transvoc.operators.trie`) and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.operators.trie import greedy_pieces
from transvoc.operators.vocab import CLS_ID, UNK_ID
from transvoc.session import scratch_path

MAX_BROADCAST_ENTRIES = 2_000_000


def words_sql(line: str) -> str:
    return f"if({line} = '', cast(array() as array<string>), split({line}, ' ', -1))"


def words_col(line: str) -> Column:
    return F.expr(words_sql(line))


def _vocab_side(vocab: DataFrame, known_entries: int | None, limit: int,
                key: str = "token", val: str = "id") -> DataFrame:
    v = vocab.select(F.col("lang").alias("vocab_lang"), F.col("token").alias(key),
                     F.col("id").cast("int").alias(val))
    if known_entries is not None and known_entries <= limit:
        return F.broadcast(v)
    return v


def with_vocab_langs(lines: DataFrame, vocab: DataFrame, pairs,
                     info: DataFrame | None = None) -> DataFrame:
    """Attach ``vocab_lang``: ``'same'`` (own language), ``'all'`` (every
    vocabulary) or an explicit ``(vocab_lang, lang)`` DataFrame.  ``info``
    (one row per vocabulary) saves the distinct over the vocabulary."""
    if "vocab_lang" in lines.columns:
        return lines
    if isinstance(pairs, DataFrame):
        return lines.join(F.broadcast(pairs.select("vocab_lang", "lang")), "lang")
    if pairs == "same":
        return lines.withColumn("vocab_lang", F.col("lang"))
    if pairs == "all":
        # the vocabulary-language side is one row per language (a small fixed
        # dimension); each line is scored under each of them
        langs = (info.select("vocab_lang") if info is not None else
                 vocab.select(F.col("lang").alias("vocab_lang")).distinct())
        return lines.crossJoin(F.broadcast(langs))
    raise ValueError(f"pairs must be 'same', 'all' or a DataFrame, got {pairs!r}")


def token_rows(lines: DataFrame, keys: Sequence[str], line_col: str = "line") -> DataFrame:
    """``(keys..., pos, token, prev_token)``; ``prev_token`` is NULL at pos 0.

    The word array is zipped with itself shifted by one and exploded, so an
    exploded row never carries its line's whole array and the expressions
    stay inside whole-stage codegen (no lambda functions).
    """
    ws = "__ws"
    base = lines.select(*keys, words_col(line_col).alias(ws))
    prev = F.concat(F.array(F.lit(None).cast("string")),
                    F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))))
    zipped = F.arrays_zip(F.col(ws).alias("token"), prev.alias("prev_token"))
    # arrays_zip pads to the longer input: an empty line yields one NULL token
    return (base.select(*keys, F.posexplode(zipped).alias("pos", "__z"))
            .select(*keys, "pos", "__z.token", "__z.prev_token")
            .filter(F.col("token").isNotNull()))


def encode_long(lines: DataFrame, vocab: DataFrame, pairs="same",
                keys: Sequence[str] = ("lang", "doc_id", "line_no"), line_col: str = "line",
                known_entries: int | None = None,
                max_broadcast_entries: int = MAX_BROADCAST_ENTRIES,
                prepend: int = CLS_ID, unk: int = UNK_ID,
                info: DataFrame | None = None) -> DataFrame:
    """Word-mode JN-7 in long form.

    Output ``(vocab_lang, keys..., pos, token, token_id, prev_id)`` where
    ``prev_id`` is ``prepend`` at position 0.
    """
    keys = [k for k in keys if k != "vocab_lang"]
    base = with_vocab_langs(lines, vocab, pairs, info)
    rows = token_rows(base, ["vocab_lang", *keys], line_col)
    cur = _vocab_side(vocab, known_entries, max_broadcast_entries, "token", "__id")
    prv = _vocab_side(vocab, known_entries, max_broadcast_entries, "prev_token", "__pid")
    out = (rows.join(cur, ["vocab_lang", "token"], "left")
           .join(prv, ["vocab_lang", "prev_token"], "left"))
    return out.select(
        "vocab_lang", *keys, "pos", "token",
        F.coalesce("__id", F.lit(unk)).alias("token_id"),
        F.when(F.col("pos") == 0, F.lit(prepend))
        .otherwise(F.coalesce("__pid", F.lit(unk))).cast("int").alias("prev_id"))


def regroup(long_rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("pos",),
            value: str = "token_id", out: str = "ids") -> DataFrame:
    """Long rows back to one ordered ``array<int>`` per ``keys`` (one shuffle)."""
    st = F.struct(*[F.col(o) for o in order], F.col(value).alias("__v"))
    return long_rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(st)).getField("__v").alias(out))


def encode(lines: DataFrame, vocab: DataFrame, mode: str = "word", pairs="same",
           keys: Sequence[str] = ("lang", "doc_id", "line_no"), line_col: str = "line",
           out: str = "ids", max_len: int | None = None, known_entries: int | None = None,
           max_broadcast_entries: int = MAX_BROADCAST_ENTRIES,
           carry: Sequence[str] = (), info: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """JOB-1 in array form: ``(vocab_lang, keys..., carry..., out array<int>)``.

    Lines without tokens get an empty array.  ``max_len`` truncates (SRT-5).
    ``carry`` columns are constant per line and travel with the keys.  Words meet a vocabulary that the caller's
    ``known_entries`` bounds in Arrow batches of whole lines, a larger one by joins.  Lines that explicit ``pairs``
    (each counted once) give several vocabularies are then shuffled once for all of them.  With a ``block``, a column that does
    not fall along the ``keys`` after ``lang``, these are dealt by block, and each row gets ``before``: the tokens, and a
    separator a row, of the earlier rows of its language and block (:func:`transvoc.operators.packing.pack_segments`).
    """
    keys = [k for k in keys if k != "vocab_lang"]
    gkeys = ["vocab_lang", *keys, *carry]
    batches = mode == "word" and known_entries is not None and known_entries <= max_broadcast_entries
    if batches and isinstance(pairs, DataFrame) and "lang" in keys and "vocab_lang" not in lines.columns:
        if block is not None and max_len is not None:
            raise ValueError("places in a block are those of whole lines")
        texts = with_vocab_langs(_texts(lines, [*keys, *carry], line_col, block), vocab, pairs.distinct())
        gkeys = [*gkeys, "before"] if block is not None else gkeys
        return _encode_texts(texts.select(*gkeys, "__texts"), vocab, gkeys, out, max_len)
    base = with_vocab_langs(lines, vocab, pairs, info)
    if batches:
        return _encode_texts(_texts(base, gkeys, line_col), vocab, gkeys, out, max_len)
    if mode == "word":
        longf = encode_long(base.select(*gkeys, line_col), vocab, pairs, [*keys, *carry],
                            line_col, known_entries, max_broadcast_entries, info=info)
        arr = regroup(longf, gkeys, out=out)
    elif mode == "greedy":
        occ = token_rows(base.select(*gkeys, line_col), gkeys, line_col).withColumnRenamed(
            "token", "word")
        pcs = greedy_pieces(occ.select("vocab_lang", "word"), vocab)
        exploded = (occ.join(pcs, ["vocab_lang", "word"], "inner")
                    .select(*gkeys, "pos", F.posexplode("ids").alias("k", "token_id")))
        arr = regroup(exploded, gkeys, order=("pos", "k"), out=out)
    else:
        raise ValueError(f"unknown tokenizer mode {mode!r}")
    empty = (base.filter(F.size(words_col(line_col)) == 0)
             .select(*gkeys, F.array().cast("array<int>").alias(out)))
    res = arr.unionByName(empty)
    if max_len is not None:
        res = res.withColumn(out, F.slice(F.col(out), 1, int(max_len)))
    return res


def write_vocabularies(vocab: DataFrame) -> str:
    """Vocabularies as a table in the shared folder, for :func:`read_vocabularies` in the workers."""
    path = scratch_path(vocab.sparkSession, "vocabularies")
    vocab.select("lang", "token", F.col("id").cast("int").alias("id")).write.parquet(path)
    return path


def read_shared(path: str) -> pa.Table:
    """A Parquet table in the shared folder, read in a worker."""
    system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
    return pq.read_table(folder, filesystem=system).combine_chunks()


def read_vocabularies(path: str, unk: int = UNK_ID) -> tuple[list[str], pa.Array, np.ndarray]:
    """Languages, the distinct tokens of all vocabularies, and the ids: a row a language, a column a token; a last
    row and a last column of unknown ids."""
    table = read_shared(path)
    lang, token = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "token"))
    ids = np.full((len(lang.dictionary) + 1, len(token.dictionary) + 1), unk, np.int32)
    ids[lang.indices.to_numpy(), token.indices.to_numpy()] = table.column("id").to_numpy()
    return lang.dictionary.to_pylist(), token.dictionary, ids


def _texts(lines: DataFrame, keys: Sequence[str], line_col: str, block: Column | None = None) -> DataFrame:
    """``(keys.., __texts)``: lines with one key meet by a shuffle of text; with a ``block`` also ``before``."""
    lines = lines.where(F.col(line_col).isNotNull())
    if block is None:
        return lines.groupBy(*keys).agg(F.collect_list(line_col).alias("__texts"))
    dealt = ["lang", "__block"]
    texts = (lines.withColumn("__block", block).repartition(*dealt).groupBy(*dealt, *(k for k in keys if k != "lang"))
             .agg(F.collect_list(line_col).alias("__texts")))
    words = F.expr(f"aggregate(__texts, 0L, (n, x) -> n + size({words_sql('x')}))")
    rows = F.expr("size(filter(__texts, x -> x = '')) + int(exists(__texts, x -> x != ''))")
    before = Window.partitionBy(*dealt).orderBy(*(k for k in keys if k != "lang")).rowsBetween(Window.unboundedPreceding, -1)
    return (texts.withColumn("__n", words + rows).withColumn("before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
            .select(*keys, "before", "__texts"))


def _encode_texts(texts: DataFrame, vocab: DataFrame, gkeys: Sequence[str], out: str, max_len: int | None) -> DataFrame:
    """Word-mode :func:`encode` of ``(gkeys.., __texts)``: words are looked up in Arrow batches.
    Of lines with one key, the empty ones stay for themselves and the ids of the others are merged by position."""
    path = write_vocabularies(vocab)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tokens, ids = read_vocabularies(path)
        for batch in batches:
            rows, lists = _line_ids(batch.column("__texts"), batch.column("vocab_lang"), langs, tokens, ids)
            cols = {c: batch.column(c).take(rows) for c in gkeys} | {out: lists}
            if "before" in cols:
                cols["before"] = pc.add(cols["before"], _earlier(rows, lists))
            yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

    res = texts.mapInArrow(run, f"{kinds}, `{out}` array<int>")
    return res if max_len is None else res.withColumn(out, F.slice(F.col(out), 1, int(max_len)))


def _line_ids(texts: pa.ListArray, vocab_langs: pa.Array, langs: list[str], tokens: pa.Array,
              ids: np.ndarray) -> tuple[pa.Array, pa.ListArray]:
    """Rows, repeated for empty lines, and the ids of each."""
    lines = texts.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy())
    empty = pc.equal(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(lines.filter(pa.array(~empty)), " ")
    sizes = pc.list_value_length(split).to_numpy()
    of = np.repeat(row[~empty], sizes)
    of_lang = pc.fill_null(pc.index_in(vocab_langs, value_set=pa.array(langs, pa.string())), len(langs)).to_numpy()
    found = pc.fill_null(pc.index_in(split.flatten(), value_set=tokens), len(tokens)).to_numpy()
    values = ids[of_lang[of], found]
    if len(np.unique(row[~empty])) < len(sizes):  # more lines than one with a key
        pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = values[np.lexsort((values, pos, of))]
    rows, k = np.unique(of, return_counts=True)
    ends = np.concatenate(([0], np.cumsum(k), np.full(int(empty.sum()), len(of)))).astype(np.int32)
    return pa.array(np.concatenate((rows, row[empty]))), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _earlier(rows: pa.Array, lists: pa.ListArray) -> pa.Array:
    """Tokens and separators of the earlier rows with the same key: the ids of its lines, then its empty lines."""
    rows, n = rows.to_numpy(), pc.list_value_length(lists).to_numpy()
    k = int(np.count_nonzero(n))  # empty lines come last, by row
    ids = np.zeros(rows.max(initial=-1) + 1, np.int64)
    ids[rows[:k]] = n[:k] + 1
    empty = rows[k:]
    return pa.array(np.concatenate((np.zeros(k, np.int64), ids[empty] + np.arange(len(empty)) - np.searchsorted(empty, empty))))


def tokenize_with(fn: Callable[[pd.Series], pd.Series]):
    """UDF-2: wrap a user tokenizer (``Series[str] -> Series[list[int]]``) as an
    Arrow-batched pandas UDF returning ``array<int>``."""
    @F.pandas_udf("array<int>")
    def _tok(s: pd.Series) -> pd.Series:
        return fn(s)
    return _tok


def tokenize_with_artifact(path: str, load: Callable, fn: Callable):
    """UDF-2 for a tokenizer that has to be loaded: ``load`` gets the Parquet table at ``path``, a shared folder, as
    an Arrow table, once a task; ``fn(loaded, vocab_lang, text)`` then turns each batch into lists of ids.
    The tokenizer neither passes the driver nor travels with the query."""
    @F.pandas_udf("array<int>")
    def _tok(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
        loaded = load(pq.read_table(folder, filesystem=system))
        for vocab_lang, text in batches:
            yield fn(loaded, vocab_lang, text)
    return _tok
