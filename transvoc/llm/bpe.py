"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Encoding, in four steps:

1. every text is cut into pre-tokens by the vocabulary's pattern; a *block* of
   consecutive documents keeps its distinct pre-tokens ("words") once, and each
   document the positions of its words as slots of that list;
2. the words are dealt by their hash over the word buckets, so that all
   occurrences of a word, from all blocks, meet in one bucket;
3. each bucket encodes each distinct word once (greedy merges by rank) and
   sends the ids back to the blocks that asked;
4. documents and ids meet by block, and the ids are put in the order of the
   slots.

Decoding looks ids up in a constant array, the token-byte table by id (at most the
vocabulary's size), which replaces a join, and joins the bytes in order; an id
without a token is an error.

Scale: no row exists per token, and a word that a block holds a million times
crosses the network once for that block.  Blocks and buckets are bounded
(``BLOCK_CHARS``, and the words of one of as many buckets as the session has shuffle partitions), so a frequent word, a
hot source or a very long document never gathers in one task.  What the first
step made is written once below ``spark.checkpoint.dir``; later steps read it,
and a lost executor costs only its own tasks.

Defined results: null text is the empty text: no ids, decoded to the empty
string.  Repeated rows each give a row.  Special tokens in a text are ordinary
text.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transvoc.session import scratch_path

#: Characters of documents that share one word list (a longer text is a block of its own).
BLOCK_CHARS = 12_000_000
#: Bytes up to which a word is merged by scanning.
SHORT_WORD = 64
#: White space as Unicode's White_Space property, which ``\s`` means in the vocabulary's pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and decimal ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pre_token_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` with white space spelled out, as libraries differ on ``\\s``."""
    return regex.compile(_spelled(pattern, SPACE))


def _spelled(pattern: str, space: str) -> str:
    pattern = pattern.replace(r"[^\s", f"[^{space}")
    return pattern.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


def pre_tokenizer(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern`` in a text.  For a text of ASCII alone the classes
    are spelled out, which the plain ``re`` module matches twice as fast."""
    any_text = pre_token_pattern(pattern).findall
    ascii_text = re.compile(
        _spelled(pattern, r"\t-\r ").replace(r"\p{L}\p{N}", "A-Za-z0-9")
        .replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")).findall
    return lambda text: ascii_text(text) if text.isascii() else any_text(text)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again, the leftmost pair of lowest rank is joined.

    A heap of candidate pairs over a linked list: ``O(n log n)``, so a pre-token
    of a whole text's length costs no more per byte than a short one.  For short
    words a scan for the least rank does the same with less bookkeeping.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= SHORT_WORD:
        return _merge_short(word, ranks)
    end = list(range(1, n + 1))   # end[i]: where the part that starts at i ends; -1 once joined away
    before = list(range(-1, n))   # start of the part that ends at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle < 0 or middle >= n or end[middle] != stop:
            continue  # one of the two parts has changed since
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    never = len(ranks)
    get = ranks.get
    cuts = list(range(len(word) + 1))
    rank = [get(word[i:i + 2], never) for i in range(len(word) - 1)]
    while rank and (least := min(rank)) < never:
        i = rank.index(least)
        del cuts[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[cuts[i]:cuts[i + 2]], never)
        if i:
            rank[i - 1] = get(word[cuts[i - 1]:cuts[i + 1]], never)
    return [ranks[word[a:b]] for a, b in pairwise(cuts)]


def _pack(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    (size,) = struct.unpack_from("<q", data)
    return zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=size) if size else b""


def _pack_numbers(x: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane (the upper ones nearly vanish)."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_words(words: list[bytes]) -> bytes:
    sizes = _pack_numbers(np.fromiter(map(len, words), np.uint32, len(words)))
    return struct.pack("<q", len(sizes)) + sizes + _pack(b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", data)
    ends = np.cumsum(_unpack_numbers(data[8:8 + n]), dtype=np.int64).tolist()
    body = _unpack(data[8 + n:])
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _planes(x: np.ndarray) -> list[bytes]:
    """The four bytes of each number, one string for each place (stored as four
    columns, the upper ones nearly vanish when Parquet compresses them)."""
    cut = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [cut[:, k].tobytes() for k in range(4)]


def _from_planes(planes: Sequence[bytes]) -> np.ndarray:
    cut = np.empty((len(planes[0]), 4), np.uint8)
    for k in range(4):
        cut[:, k] = np.frombuffer(planes[k], np.uint8)
    return cut.view("<u4").reshape(-1)


class _Numbered(dict):
    """Word -> its number in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


PLANES = ("b0", "b1", "b2", "b3")
SPLIT_SCHEMA = ("block long, bucket int, row struct<{fields}>, b0 binary, b1 binary, b2 binary, "
                "b3 binary, slots binary, words binary, kind string")


def _fields(struct_type) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in struct_type.fields)


def split_words(docs: DataFrame, pattern: str, buckets: int, *, text: str = "text",
                keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Step 1: rows of kind ``doc`` (the ``keep`` columns and the slots of one
    document) and ``words`` (the words of one block that fall in one bucket,
    with their slots)."""
    frame = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = SPLIT_SCHEMA.format(fields=_fields(frame.schema["row"].dataType))
    names = ["block", "bucket", "row", *PLANES, "slots", "words", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = pre_tokenizer(pattern)
        task = TaskContext.get().partitionId()
        block, chars, slots = 0, 0, _Numbered()

        def doc_rows(rows, taken, planes):
            n = len(taken)
            none = pa.nulls(n, pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | block] * n, pa.int64()), pa.nulls(n, pa.int32()),
                 rows.take(pa.array(taken, pa.int64())),
                 *(pa.array([p[k] for p in planes], pa.binary()) for k in range(4)),
                 none, none, pa.array(["doc"] * n)], names=names)

        def word_rows(row_type):
            raw = [word.encode() for word in slots]
            of = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=buckets))
            groups = [(b, order[start:end]) for b, (start, end) in enumerate(pairwise([0, *ends.tolist()]))
                      if end > start]
            n = len(groups)
            none = pa.nulls(n, pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | block] * n, pa.int64()),
                 pa.array([b for b, _ in groups], pa.int32()), pa.nulls(n, row_type), none, none, none, none,
                 pa.array([_pack_numbers(np.diff(g, prepend=0)) for _, g in groups], pa.binary()),
                 pa.array([_pack_words([raw[i] for i in g.tolist()]) for _, g in groups], pa.binary()),
                 pa.array(["words"] * n)], names=names)

        row_type = None
        for batch in batches:
            rows, row_type = batch.column(0), batch.column(0).type
            taken, planes = [], []
            for i, body in enumerate(batch.column(1)):
                body = body.as_py() or ""
                if chars and chars + len(body) > block_chars:
                    if taken:
                        yield doc_rows(rows, taken, planes)
                        taken, planes = [], []
                    if slots:
                        yield word_rows(row_type)
                    block, chars, slots = block + 1, 0, _Numbered()
                found = find(body)
                taken.append(i)
                planes.append(_planes(np.fromiter(map(slots.__getitem__, found), np.uint32, len(found))))
                chars += len(body)
            if taken:
                yield doc_rows(rows, taken, planes)
        if slots:
            yield word_rows(row_type)

    return frame.mapInArrow(run, schema)


def encode_words(words: DataFrame, ranks: dict[bytes, int], buckets: int) -> DataFrame:
    """Steps 2 and 3: for each row of words, how many ids each word has, and the
    ids.  A word has one bucket and a bucket one task, so each distinct word is
    merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            counts, ids = [], []
            for payload in batch.column(2):
                lists = []
                for word in _unpack_words(payload.as_py()):
                    if (found := known.get(word)) is None:
                        found = known[word] = merge_word(word, ranks)
                    lists.append(found)
                counts.append(_pack_numbers(np.fromiter(map(len, lists), np.uint32, len(lists))))
                ids.append(_pack_numbers(np.fromiter(chain.from_iterable(lists), np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.binary()),
                 pa.array(ids, pa.binary())], names=["block", "slots", "counts", "ids"])

    return (words.repartition(buckets, "bucket").select("block", "slots", "words")
            .mapInArrow(run, "block long, slots binary, counts binary, ids binary"))


def reassemble(parts: DataFrame, encoded: DataFrame) -> DataFrame:
    """Step 4: ``row, n_tokens, ids`` of every document, block by block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = [(np.cumsum(_unpack_numbers(s), dtype=np.int64), _unpack_numbers(c), _unpack_numbers(i))
                  for s, c, i in zip(*(right.column(k).to_pylist() for k in ("slots", "counts", "ids")),
                                     strict=True)]
        total = sum(len(p[0]) for p in pieces)
        count, start = np.zeros(total, np.int64), np.zeros(total, np.int64)
        flat, at = [np.empty(0, np.uint32)], 0
        for slot, n, ids in pieces:
            count[slot] = n
            start[slot] = at + np.cumsum(n, dtype=np.int64) - n
            flat.append(ids)
            at += len(ids)
        pool = np.concatenate(flat)
        lists, sizes = [np.empty(0, np.uint32)], []
        for planes in zip(*(left.column(p) for p in PLANES), strict=True):
            slot = _from_planes([p.as_py() for p in planes])
            n = count[slot]
            end = np.cumsum(n)
            size = int(end[-1]) if len(end) else 0
            lists.append(pool[np.repeat(start[slot] - end + n, n) + np.arange(size)])
            sizes.append(size)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))
        return pa.table({"row": left.column("row"), "n_tokens": pa.array(sizes, pa.int64()),
                         "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).view(np.int32)))})

    schema = f"row struct<{_fields(parts.schema['row'].dataType)}>, n_tokens long, ids array<int>"
    return parts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text",
           keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with ``n_tokens`` and ``ids``."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bucketed by block, so that the documents' slots are not shuffled again for step 4.  The table
    # ``bpe_parts_...`` stays in the session's catalog, as the result is read from it lazily.
    path, name = scratch_path(spark, "bpe-parts"), f"bpe_parts_{uuid.uuid4().hex}"
    (split_words(docs, pattern, buckets, text=text, keep=keep, block_chars=block_chars)
     .write.partitionBy("kind").bucketBy(buckets, "block").option("path", path)
     .option("compression", "zstd").saveAsTable(name))
    parts = spark.table(name)
    encoded = encode_words(parts.where("kind = 'words'").select("block", "bucket", "slots", "words"),
                           load_ranks(ranks_path), buckets)
    whole = reassemble(parts.where("kind = 'doc'").select("block", "row", *PLANES), encoded)
    return whole.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "n_tokens", "ids")


def token_table(ranks_path: str) -> Column:
    """The token-byte table as a constant: an array of hexadecimal strings by id."""
    ranks = load_ranks(ranks_path)
    by_id = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token.hex()
    return F.split(F.lit(" ".join(by_id)), " ")


def decode(encoded: DataFrame, ranks_path: str, *, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of each row's ids, in order (null ids: null; an unknown id: an error)."""
    table = token_table(ranks_path)
    known = lambda i: F.coalesce(
        F.nullif(F.get(table, i), F.lit("")),
        F.raise_error(F.concat(F.lit("no token for id "), F.coalesce(i.cast("string"), F.lit("null")))))
    return encoded.withColumn("decoded", F.unhex(F.array_join(F.transform(ids, known), "")))
