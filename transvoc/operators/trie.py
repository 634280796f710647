"""Longest-match segmentation with a trie (JOB-1 greedy mode).

A vocabulary table becomes a trie whose edges are kept in one table
``(node, character) -> node``; a word is walked from left to right once, each
time as deep as an entry reaches.  Distinct words are dealt into batches whose
number follows their count; each batch meets the entries of its vocabulary in a
cogroup, so nothing passes through the driver and a task holds one vocabulary
and one batch.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transvoc.operators.vocab import UNK_ID

#: Distinct words that share one trie.
BATCH_WORDS = 50_000


class Trie:
    """Entries by character; ``ids[node]`` is the id of the entry that ends there, else -1."""

    def __init__(self, entries: Iterable[tuple[str, int]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ids = [-1]
        for text, number in entries:
            node = 0
            for ch in text:
                if (after := self.edges.get((node, ch))) is None:
                    after = self.edges[node, ch] = len(self.ids)
                    self.ids.append(-1)
                node = after
            if node and (self.ids[node] < 0 or number < self.ids[node]):
                self.ids[node] = number

    def pieces(self, word: str, unk: int = UNK_ID) -> list[int]:
        """Ids of the longest entries from left to right; a character that begins none is one unknown piece."""
        out, at, edges, ids = [], 0, self.edges, self.ids
        while at < len(word):
            node, best, end = 0, unk, at + 1
            for i in range(at, len(word)):
                if (node := edges.get((node, word[i]))) is None:
                    break
                if ids[node] >= 0:
                    best, end = ids[node], i + 1
            out.append(best)
            at = end
        return out


def greedy_pieces(words_df: DataFrame, pieces: DataFrame, unk: int = UNK_ID,
                  batch_words: int = BATCH_WORDS) -> DataFrame:
    """``(vocab_lang, word, ids array<int>)`` of every distinct ``(vocab_lang, word)``; ``pieces`` is
    ``(lang, token, id)``.  An empty word has no pieces; a word of a language without
    vocabulary is all unknown."""
    words = words_df.select("vocab_lang", "word").distinct()
    batches = words.groupBy("vocab_lang").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(batch_words)).alias("batches"))
    left = (words.join(F.broadcast(batches), "vocab_lang")  # one row a vocabulary
            .withColumn("batch", F.pmod(F.xxhash64("word"), F.col("batches")))
            .select("vocab_lang", "batch", "word"))
    right = (pieces.select(F.col("lang").alias("vocab_lang"), "token", F.col("id").cast("int").alias("id"))
             .join(F.broadcast(batches), "vocab_lang")
             .withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
             .select(F.col("vocab_lang").alias("v"), F.col("batch").alias("b"), "token", "id"))

    def walk(own: pa.Table, entries: pa.Table) -> pa.Table:
        trie = Trie(zip(entries.column("token").to_pylist(), entries.column("id").to_pylist(), strict=True))
        found = [trie.pieces(w, unk) for w in own.column("word").to_pylist()]
        return pa.table({"vocab_lang": own.column("vocab_lang"), "word": own.column("word"),
                         "ids": pa.array(found, pa.list_(pa.int32()))})

    return (left.groupBy("vocab_lang", "batch").cogroup(right.groupBy("v", "b"))
            .applyInArrow(walk, "vocab_lang string, word string, ids array<int>"))

