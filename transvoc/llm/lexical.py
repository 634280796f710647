"""Ranked lexical search, reversed: the documents stream past an index of the items.

Usually an index of the documents answers a few queries.  Here the items (the
queries) are indexed: term -> the items that hold it and how often.  The index
is broadcast, each task streams its documents' term counts through it, adds up
the scores of the items that a document meets, and keeps a heap of the ``top``
best documents for each item.  The tasks' heaps are then merged item by item.

1. One pass over the texts keeps, for each document, its number of terms and the
   counts of those terms that some item holds, written once below
   ``spark.checkpoint.dir``.  Document counts of terms, the number of documents and
   of all terms are sums over that table.
2. A second pass streams that table through the index.  The score of a document
   for an item is the sum over the item's terms, repeats included, of
   ``weight * ((10**9 * tf) div (1000 * tf + 8 * m))`` with
   ``weight = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
   ``m = 25 + (75 * n * N) div L``, all but the logarithm in 64-bit integers.

Scale: documents are never shuffled by term, so a frequent word costs its postings in
each document and gathers nowhere.  A task holds ``top`` documents an item.  Heaps
are merged in two steps, so that an item's heaps of all tasks don't meet in one
sort.  The index has a bound: items are dealt over blocks that end when they have
``INDEX_TERMS`` terms, so one more item's at most; each block streams the documents
again, so any number of items is answered in whole.

Defined results: a term is a run of letters and digits of ASCII, lower-cased, and
of any other characters beyond ASCII.  Null or empty texts have no terms: such a document is
never found, such an item finds nothing.  Very long texts are read whole.  Equal scores are ranked by
ascending key, a null key last; repeated rows are ranked one by one, and repeated items
each get their ranking.  Scores of 0 are left out.  An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transvoc.session import cut_lineage

#: Terms of the items of one block (distinct terms of each item), about.
INDEX_TERMS = 500_000
#: Scores that a task adds up at a time: documents times items, and the postings that the documents meet.
CELLS = 500_000
#: Parts that the tasks' heaps of one item are merged in first.
SALTS = 32
#: Fixed value: ASCII letters are lower-cased, other ASCII characters than letters and digits part terms.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; characters beyond ASCII are bytes from 0x80 on."""
    return text.translate(FOLD).split(b" ")


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs."""
    counts = Counter(terms_of(text or b""))
    del counts[b""]
    return counts


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """``item, key, terms, counts`` of each item; ``item`` is its number in this job."""
    frame = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["key", "terms", "counts"])

    kind = frame.schema["key"].dataType.simpleString()
    return (frame.mapInArrow(run, f"key {kind}, terms array<binary>, counts array<long>")
            .withColumn("item", F.monotonically_increasing_id()))


def blocks_of(listed: DataFrame, index_terms: int) -> DataFrame:
    """Items with ``block``: they are taken one after the other, and a block ends when it has ``index_terms`` terms."""
    sized = listed.withColumns({"part": F.shiftright("item", 33), "size": F.size("terms").cast("long")})
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("size").over(so_far(w)), F.lit(0))
    parts = (sized.groupBy("part").agg(F.sum("size").alias("size"))  # one row a task
             .select("part", before(Window.orderBy("part")).alias("before")))
    within = sized.withColumn("within", before(Window.partitionBy("part").orderBy("item")))
    return within.join(parts, "part").select(
        "item", "key", "terms", "counts",
        F.floor((F.col("before") + F.col("within")) / F.lit(index_terms)).cast("long").alias("block"))


class Index:
    """Items by term: for each term the items that hold it, and how often."""

    def __init__(self, rows: list):
        self.items = [r["item"] for r in rows]
        self.number: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for place, r in enumerate(rows):
            for term, n in zip(r["terms"], r["counts"], strict=True):
                term = bytes(term)
                if (t := self.number.setdefault(term, len(self.number))) == len(postings):
                    postings.append([])
                postings[t].append((place, n))
        sizes = np.array([len(p) for p in postings], np.int64)
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        flat = np.array([x for p in postings for x in p], np.int64).reshape(-1, 2)
        self.place, self.times = flat[:, 0].copy(), flat[:, 1].copy()


def count_terms(docs: DataFrame, index: Index, text: str, key: str) -> DataFrame:
    """``key, n, terms, counts`` of every document with terms: how many it has, and the number in the
    index and the count of each that an item holds."""
    frame = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            size, rows, terms, counts, ends = [], [], [], [], [0]
            for i, body in enumerate(batch.column(1)):
                found = term_counts(body.as_py())
                if not found:
                    continue
                rows.append(i)
                size.append(found.total())
                common = found.keys() & number.keys()
                terms.extend(map(number.__getitem__, common))
                counts.extend(map(found.__getitem__, common))
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                names=["key", "n", "terms", "counts"])

    kind = frame.schema["key"].dataType.simpleString()
    return frame.mapInArrow(run, f"key {kind}, n long, terms array<int>, counts array<int>")


def weights(found: np.ndarray, docs: int) -> np.ndarray:
    """Weight of each term from the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in found.tolist()], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What one occurrence in an item adds, before the weight: more for frequent terms, less for long documents."""
    m = 25 + (75 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def best_documents(counted: DataFrame, index: Index, weight: np.ndarray, docs: int, terms: int, top: int) -> DataFrame:
    """``item, score, key``: each task's heaps."""
    shared = counted.sparkSession.sparkContext.broadcast((index, weight))
    kind = counted.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weight = shared.value
        width = len(found.items)
        heaps: list[list] = [[] for _ in range(width)]
        bar = np.ones(width, np.int64)  # the score that a document needs
        for batch in batches:
            for at, step in _steps(batch, found):
                part = batch.slice(at, step)
                keys = part.column(0).to_pylist()
                scores = _scores(part, found, weight, docs, terms)
                for i, j in zip(*(x.tolist() for x in np.nonzero(scores >= bar)), strict=True):
                    own = keys[i]
                    # The heap's first is the worst: the least score, of equal ones the largest key, null before all.
                    entry = (int(scores[i, j]), own is not None, -own if own is not None else 0)
                    heap = heaps[j]
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == top:
                        bar[j] = heap[0][0]
        rows = [(found.items[j], score, -least if known else None)
                for j, heap in enumerate(heaps) for score, known, least in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["item", "score", "key"])

    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"the documents' key must be a whole number, not {kind}")
    return (counted.withColumn("key", F.col("key").cast("long"))
            .mapInArrow(run, "item long, score long, key long"))


def _steps(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, int]]:
    """Where to begin and how many documents to take, so that the work at a time stays about ``CELLS``
    (one document meets no more than the index' postings)."""
    term = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    met = np.concatenate(([0], np.cumsum(index.size[term])))[ends]
    most, at = max(1, CELLS // len(index.items)), 0
    while at < batch.num_rows:
        before = int(met[at - 1]) if at else 0
        step = min(most, max(1, int(np.searchsorted(met, before + CELLS, side="right")) - at), batch.num_rows - at)
        yield at, step
        at += step


def _scores(part: pa.RecordBatch, index: Index, weight: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Scores of a batch's documents (rows) for the index' items (columns)."""
    n = part.column(1).to_numpy(zero_copy_only=False)
    sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    term = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), sizes)
    value = weight[term] * impacts(tf, n[row], docs, terms)
    postings = index.size[term]
    ends = np.cumsum(postings)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(index.start[term] - ends + postings, postings) + np.arange(total)
    width = len(index.items)
    scores = np.zeros(len(n) * width, np.int64)
    np.add.at(scores, np.repeat(row, postings) * width + index.place[at],
              np.repeat(value, postings) * index.times[at])
    return scores.reshape(len(n), width)


def merged(heaps: DataFrame, top: int) -> DataFrame:
    """``item, rank, key, score``: the best of all tasks' heaps, in two steps."""
    best = (F.col("score").desc(), F.col("key").asc_nulls_last())
    salted = heaps.withColumn("salt", F.spark_partition_id() % SALTS)
    some = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best)))
            .where(F.col("rank") <= top))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best)))
            .where(F.col("rank") <= top).select("item", "rank", "key", "score"))


def search(docs: DataFrame, items: DataFrame, *, top: int = 10, text: str = "text", key: str = "doc_id",
           item_text: str = "text", item_key: str = "item_id", index_terms: int = INDEX_TERMS) -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` best documents of each item."""
    listed = cut_lineage(item_terms(items, item_text, item_key), "lexical-items")
    listed = listed.where(F.size("terms") > 0)
    if listed.isEmpty():
        return (listed.join(docs.select(F.col(f"`{key}`").cast("long").alias("doc")), F.lit(False))
                .select(F.col("key").alias(item_key), F.lit(0).alias("rank"), F.col("doc").alias(key),
                        F.lit(0).cast("long").alias("score")))
    dealt = cut_lineage(blocks_of(listed, index_terms), "lexical-blocks")
    found = None
    for block in sorted(r["block"] for r in dealt.select("block").distinct().collect()):
        index = Index(dealt.where(F.col("block") == block).orderBy("item").collect())
        ranked = _search_block(docs, index, text, key, top)
        found = ranked if found is None else found.unionByName(ranked)
    names = listed.select("item", F.col("key").alias("item_key"))
    return found.join(names, "item").select(
        F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")


def _search_block(docs: DataFrame, index: Index, text: str, key: str, top: int) -> DataFrame:
    """``item, rank, key, score`` for the items of one index."""
    counted = cut_lineage(count_terms(docs, index, text, key), "lexical-counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index.number), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = weights(df, n_docs)
    return merged(best_documents(counted, index, weight, n_docs, n_terms, top), top)
