"""Vocabulary tables (JOB-2) and vocabulary set operations (JN-8, JN-9).

A vocabulary is ``(lang, token, id)``.  Reserved ids come first; ordinary
tokens are ranked by (count desc, token asc).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transvoc.functions.text import words

# Reserved token ids.
PAD_ID = 0
UNK_ID = 1
CLS_ID = 2
SEP_ID = 3
N_RESERVED = 4
#: Words that a task counts at a time, about.
COUNT_WORDS = 2_000_000


def line_tokens(lines: DataFrame, line_col: str = "line", keep=("lang",)) -> DataFrame:
    """Words of every line, position kept: ``(keep..., pos, token)``."""
    return lines.select(*keep, F.posexplode(words(line_col)).alias("pos", "token"))


def word_portions(batches: Iterator[pa.RecordBatch], line_col: str = "line",
                  most: int = COUNT_WORDS) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array]]:
    """Languages and numbers of words of non-empty lines, and their words: of as many Arrow batches as have ``most`` words."""
    langs, split, held = [], [], 0
    for batch in batches:
        some = batch.filter(pc.greater(pc.binary_length(batch.column(line_col)), 0))
        langs.append(some.column("lang"))
        split.append(pc.split_pattern(some.column(line_col), " "))
        held += len(split[-1].flatten())
        if held >= most:
            yield _joined(langs, split)
            langs, split, held = [], [], 0
    if held:
        yield _joined(langs, split)


def _joined(langs: list[pa.Array], split: list[pa.ListArray]) -> tuple[pa.Array, np.ndarray, pa.Array]:
    return (pa.concat_arrays(langs), np.concatenate([pc.list_value_length(s).to_numpy() for s in split]),
            pa.concat_arrays([s.flatten() for s in split]))


def counted_words(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``(lang, token, n bigint)``: the words of the lines of every language, counted in Arrow batches before they are
    shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, sizes, found in word_portions(batches, line_col):
            lang, word = langs.dictionary_encode(null_encoding="encode"), found.dictionary_encode()
            codes = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes) * len(word.dictionary) + word.indices.to_numpy()
            keys, n = np.unique(codes, return_counts=True)
            of, which = np.divmod(keys, len(word.dictionary))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of)), word.dictionary.take(pa.array(which)),
                                              pa.array(n.astype(np.int64))], ["lang", "token", "n"])

    kind = lines.schema["lang"].dataType.simpleString()
    return (lines.select("lang", line_col).mapInArrow(run, f"lang {kind}, token string, n bigint")
            .groupBy("lang", "token").agg(F.sum("n").alias("n")))


def top_k_per_group(counts: DataFrame, group: str, k: int, n_col: str = "n",
                    key_col: str = "token", rank_col: str = "rank") -> DataFrame:
    """Exact top-k per group, by count (descending), then key.

    A histogram of the counts tells each group's threshold: fewer than ``k`` keys
    have more.  These are taken unseen; of the keys that have exactly as many, the
    least are taken (each task passes on ``k`` of them at most).  So the last
    step ranks ``k`` keys a group, whatever the number of keys.
    """
    more = Window.partitionBy(group).orderBy(F.col(n_col).desc()).rowsBetween(Window.unboundedPreceding, -1)
    hist = counts.groupBy(group, n_col).agg(F.count(F.lit(1)).alias("__keys"))  # distinct counts of a group
    cut = (hist.withColumn("__above", F.coalesce(F.sum("__keys").over(more), F.lit(0))).where(F.col("__above") < k)
           .groupBy(group).agg(F.min(n_col).alias("__least"), F.max("__above").alias("__above")))
    held = counts.join(F.broadcast(cut), group)  # one row a group
    sure = held.where(F.col(n_col) > F.col("__least"))
    tied = (held.where(F.col(n_col) == F.col("__least"))
            .withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(key_col).asc())))
            .where(F.col("__r") <= k).where(F.col("__r") <= F.lit(k) - F.col("__above")).drop("__r"))
    order = Window.partitionBy(group).orderBy(F.col(n_col).desc(), F.col(key_col).asc())
    return sure.unionByName(tied).drop("__least", "__above").withColumn(rank_col, F.row_number().over(order))


def build_vocab(lines: DataFrame, k: int, line_col: str = "line") -> DataFrame:
    """JOB-2: top-``k`` words per language; ``id = rank + N_RESERVED - 1``.

    Output ``(lang, token, id int, n bigint)``.
    """
    return counted_vocab(counted_words(lines, line_col), k)


def counted_vocab(counts: DataFrame, k: int) -> DataFrame:
    """:func:`build_vocab` from :func:`counted_words`."""
    top = top_k_per_group(counts, "lang", k)
    return top.select("lang", "token",
                      (F.col("rank") + F.lit(N_RESERVED - 1)).cast("int").alias("id"), "n")


def piece_vocab(vocab: DataFrame, lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Vocabulary plus every single character seen in the language's lines.

    Characters that are not already tokens get ids after the largest id of the
    language's vocabulary, in character order.  Output ``(lang, token, id)``.
    """
    return counted_piece_vocab(vocab, counted_words(lines, line_col))


def counted_piece_vocab(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """:func:`piece_vocab` from :func:`counted_words`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode(null_encoding="encode")
            for i in range(len(lang.dictionary)):
                own = batch.column("token").filter(pc.equal(lang.indices, i)).drop_null()
                found = sorted(set().union(*own.to_pylist()))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array([i] * len(found), pa.int32())),
                                                  pa.array(found, pa.string())], ["lang", "token"])

    kind = counts.schema["lang"].dataType.simpleString()
    chars = counts.select("lang", "token").mapInArrow(run, f"lang {kind}, token string").distinct()
    new_chars = chars.join(vocab.select("lang", "token"), ["lang", "token"], "left_anti")
    top = vocab.groupBy("lang").agg(F.max("id").alias("__max"))
    w = Window.partitionBy("lang").orderBy("token")
    extra = (new_chars.join(F.broadcast(top), "lang")
             .select("lang", "token",
                     (F.col("__max") + F.row_number().over(w)).cast("int").alias("id")))
    return vocab.select("lang", "token", "id").unionByName(extra)
