"""Packing documents into sequences by swap-based local search.

A document's token ids, with a separator after them, are cut into pieces of at
most ``capacity`` tokens (only longer documents are cut).  A piece of exactly
``capacity`` is a sequence; the others share sequences ("bins"):

1. the pieces are dealt at random over groups of about ``GROUP`` pieces; in each
   group every piece, the longest first, goes to the bin with the least room for it;
2. a local search then exchanges pieces between underfull bins: it moves one
   piece, or exchanges one for one, two for one or one for two, always so that a
   fuller bin gains what an emptier one loses, which raises the sum of squared
   fills.  The emptiest bin gives first, and each time by the exchange by which it
   loses most; a bin that has given everything is gone.  The search ends when the bins
   are as few as their tokens allow, or the emptiest have no exchange left;
3. underfull bins (at most one in ``PASSED_ON`` of a group's, the emptiest) meet as
   they are in fewer, new groups and are searched again, level by level, until one
   group is left.

Scale: a group is bounded, whatever source or length is common, since pieces are
dealt by their row number, not by what they hold; the levels shrink by
``PASSED_ON``, so the last one is a single group.  Pieces carry their checksum, not
their ids: no token is shuffled.  Each level is written below
``spark.checkpoint.dir``, so a lost executor costs only its own tasks.

Defined results: null or empty text has no ids: its piece is the separator alone.
Long texts give several pieces, the last may be shorter.  Repeated rows and equal
keys are packed one by one.  Equal exchanges are decided by the bins' order, so a
rerun over the same rows in the same partitions agrees.  An empty table gives an
empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transvoc.session import cut_lineage

#: Pieces in one group, about.
GROUP = 4096
#: One in so many bins of a group goes on to the next level at most.
PASSED_ON = 16
#: The emptiest bins of a group; the search of a group ends when none of them can give anything.
DONORS = 16
#: Words and parts of words whose ids a process remembers at a time.
KNOWN = 600_000
#: Fixed value: white space as Unicode's White_Space property, which is ``\s`` in the vocabulary's pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the vocabulary's pattern for lower-case text of characters up to U+00FF.
LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                         rf"|[^{SPACE}a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: The same for ASCII in any case; whatever holds another character and has no white space inside is one part.
ANY_PARTS = re.compile(rf"[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f{SPACE}][^{SPACE}]*|'[sS]|'[tT]|'[rR][eE]|'[vV][eE]"
                       rf"|'[mM]|'[lL][lL]|'[dD]|[A-Za-z]+|[0-9]|[^{SPACE}0-9A-Za-z]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it is visible, else one after U+00FF."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + others.index(b)) for b in range(256)]


def is_latin(text: str) -> bool:
    """Whether all characters are up to U+00FF."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PartIds(dict):
    """Part of a text -> its ids as little-endian 32-bit numbers.

    No token reaches over white space or over a match of the vocabulary's pattern,
    so a text's ids are those of its parts one after the other.  In Latin-1 text,
    which no normalization changes but by case, the matches are found here; a word
    with any other character goes to the library whole.  Strings of special tokens
    are ordinary text.  Forgets everything when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        if is_latin(part) and len(LATIN_PARTS.findall(part.lower())) == 1:
            letters = part.lower().encode().decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.tokenizer.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        self[part] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def of_text(self, text: str) -> bytes:
        parts = LATIN_PARTS.findall(text.lower()) if is_latin(text) else ANY_PARTS.findall(text)
        return b"".join(map(self.__getitem__, parts))


@lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    """What this process knows of a vocabulary; its later tasks begin with it."""
    return PartIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           capacity: int = 2048, separator: int = 0) -> DataFrame:
    """``row`` (the ``keep`` columns), ``piece, start, length, ids_crc32`` of every piece."""
    frame = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(text).alias("text"))
    end = np.array([separator], "<u4").tobytes()
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = part_ids(tokenizer_path)
        for batch in batches:
            of, piece, length, crc = [], [], [], []
            for i, body in enumerate(batch.column(1)):
                ids = known.of_text(body.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), size)):
                    cut = ids[at:at + size]
                    of.append(i)
                    piece.append(k)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number),
                 pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["row", "piece", "start", "length", "ids_crc32"])

    fields = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {fields}, piece int, start long, length long, ids_crc32 long")


class Search:
    """Bins of one group of pieces, and the exchanges between its underfull bins."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int):
        self.length, self.bin, self.capacity = lengths.astype(np.int64), bins.astype(np.int64), capacity
        self.fill = np.bincount(self.bin, weights=self.length).astype(np.int64)
        self.tokens = int(self.fill.sum())
        self.least = -(-self.tokens // capacity)

    def run(self) -> np.ndarray:
        """The bin of each piece after the search: the emptiest bins give, until there are as few
        as their tokens allow or the ``DONORS`` emptiest have nothing that they can give."""
        used, stuck = int((self.fill > 0).sum()), set()
        while used > self.least:
            order = np.lexsort((np.arange(len(self.fill)), self.fill))
            open_bins = order[(self.fill[order] > 0) & (self.fill[order] < self.capacity)][:DONORS]
            donor = next((int(b) for b in open_bins if int(b) not in stuck), None)
            if donor is None:
                break
            self._underfull()
            given = False
            while self.fill[donor] and (step := self._best(donor)):
                self._exchange(donor, *step)
                given = True
            if not self.fill[donor]:
                used -= 1
            if given:
                stuck.clear()
            stuck.add(donor)
        return self.bin

    def _underfull(self) -> None:
        """Pieces of underfull bins, by bin."""
        open_pieces = np.flatnonzero(self.fill[self.bin] < self.capacity)
        self.near = open_pieces[np.argsort(self.bin[open_pieces], kind="stable")]

    def _exchange(self, donor: int, given: list[int], taker: int, taken: list[int]) -> None:
        gain = int(self.length[given].sum() - self.length[taken].sum())
        self.bin[given] = taker
        self.bin[taken] = donor
        self.fill[donor] -= gain
        self.fill[taker] += gain
        self._underfull()

    def _best(self, donor: int) -> tuple[list[int], int, list[int]] | None:
        """What the donor gives, to which bin, and what it takes back: the exchange by which it loses
        most, of the first kind that has any: a move, one for one, two for one, one for two."""
        own = np.flatnonzero(self.bin == donor)
        others = np.unique(self.bin[self.near])
        others = others[others != donor]
        if not len(others):
            return None
        one = _by_sum(self.length[own], own[:, None])
        none = (np.zeros(len(others), np.int64), np.empty((len(others), 0), np.int64), others)
        best = self._choose(donor, *one, *none)
        if best:
            return best
        near = self.near[self.bin[self.near] != donor]
        singles = self.length[near], near[:, None], self.bin[near]
        best = self._choose(donor, *one, *singles)
        if best:
            return best
        two = _pairs(own, np.zeros(len(own), np.int64))
        if len(two):
            best = self._choose(donor, *_by_sum(self.length[two].sum(axis=1), two), *singles)
            if best:
                return best
        two = _pairs(near, self.bin[near])
        return self._choose(donor, *one, self.length[two].sum(axis=1), two, self.bin[two[:, 0]]) if len(two) else None

    def _choose(self, donor: int, give: np.ndarray, given: np.ndarray, take: np.ndarray, taken: np.ndarray,
                takers: np.ndarray) -> tuple[list[int], int, list[int]] | None:
        """The largest possible gain; equal ones: the taker with the least room, then the first."""
        room = self.capacity - self.fill[takers]
        least = np.maximum(1, self.fill[donor] - self.fill[takers] + 1)  # the sum of squared fills rises
        best, found = (0, 0), None
        for i in range(len(give)):  # longest first
            gain = give[i] - take
            gain[(gain < least) | (gain > room)] = 0
            top = int(gain.max())
            if top and (top, self.capacity) > best:
                at = np.flatnonzero(gain == top)
                j = int(at[np.argmin(room[at])])
                if (value := (top, self.capacity - int(room[j]))) > best:
                    best, found = value, (given[i].tolist(), int(takers[j]), taken[j].tolist())
        return found


def _by_sum(sums: np.ndarray, pieces_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One set of pieces for each sum, the largest first."""
    values, first = np.unique(sums, return_index=True)
    return values[::-1], pieces_of[first[::-1]]


def _pairs(numbers: np.ndarray, group: np.ndarray) -> np.ndarray:
    """All pairs of numbers of the same group; equal groups stand together."""
    found = []
    for k in range(1, len(numbers)):
        same = np.flatnonzero(group[:-k] == group[k:])
        if not len(same):
            break
        found.append(np.stack((numbers[same], numbers[same + k]), axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def best_fit(lengths: list[int], capacity: int) -> np.ndarray:
    """Bins of the pieces, put one after the other where the least room is left."""
    bins, rooms, has = [], {}, 0   # room -> bins that have it; bit r of has: some bin has room r
    count = 0
    for n in lengths:
        left = has >> n
        if left:
            room = n + (left & -left).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                has ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins.append(b)
        if room > n:
            rooms.setdefault(room - n, []).append(b)
            has |= 1 << (room - n)
    return np.array(bins, np.int64)


def pack_group(table: pa.Table, capacity: int, last: bool) -> pa.Table:
    """One group's rows with ``sequence_id`` (the row number of the bin's first piece), ``offset``, and
    whether the bin goes ``on`` to the next level."""
    numbers = table.column("number").to_numpy()
    lengths = table.column("length").to_numpy()
    if table.column("sequence_id").null_count:
        order = np.lexsort((numbers, -lengths))
        bins = best_fit(lengths[order].tolist(), capacity)
    else:
        order = np.argsort(numbers, kind="stable")
        bins = np.unique(table.column("sequence_id").to_numpy()[order], return_inverse=True)[1]
    bins = Search(lengths[order], bins, capacity).run()
    by_bin = np.argsort(bins, kind="stable")
    order, bins = order[by_bin], bins[by_bin]
    numbers, lengths = numbers[order], lengths[order]
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sizes = np.diff(np.append(first, len(bins)))
    before = np.cumsum(lengths) - lengths
    fills = np.add.reduceat(lengths, first) if len(first) else np.empty(0, np.int64)
    on = np.zeros(len(first), bool)
    if not last:
        emptiest = np.argsort(fills, kind="stable")[:max(1, len(first) // PASSED_ON)]
        on[emptiest] = fills[emptiest] < capacity
    put = {"sequence_id": pa.array(np.repeat(numbers[first], sizes)),
           "offset": pa.array(before - np.repeat(before[first], sizes)), "on": pa.array(np.repeat(on, sizes))}
    table = table.take(pa.array(order)).drop_columns(["sequence_id", "group"])
    for name, column in put.items():
        table = table.append_column(name, column)
    return table


def level(open_pieces: DataFrame, key: str, groups: int, capacity: int) -> DataFrame:
    """The pieces searched in ``groups`` new groups, dealt by ``key``."""
    dealt = open_pieces.withColumn("group", F.pmod(F.xxhash64(key, F.lit(groups)), F.lit(groups)))
    fields = open_pieces.schema["row"].dataType.simpleString()
    schema = (f"row {fields}, piece int, start long, length long, ids_crc32 long, number long, "
              "sequence_id long, offset long, on boolean")
    return dealt.groupBy("group").applyInArrow(lambda table: pack_group(table, capacity, groups == 1), schema)


def pack(docs: DataFrame, tokenizer_path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         capacity: int = 2048, separator: int = 0, group: int = GROUP) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut = pieces(docs, tokenizer_path, text=text, keep=keep, capacity=capacity, separator=separator)
    numbered = cut_lineage(cut.withColumn("number", F.monotonically_increasing_id()), "packing-pieces")
    whole = F.col("length") == capacity
    done = [numbered.where(whole).withColumns({"sequence_id": F.col("number"), "offset": F.lit(0).cast("long")})]
    rest = numbered.where(~whole).withColumn("sequence_id", F.lit(None).cast("long"))
    key, left = "number", rest.count()
    while left:
        groups = -(-left // group)
        packed = cut_lineage(level(rest, key, groups, capacity), "packing-level")
        done.append(packed.where(~F.col("on")))
        rest, before = packed.where("on").drop("offset", "on"), left
        left = rest.count()
        if 2 * left > before:  # pieces so short that a group is hardly more than its underfull bins
            done.append(packed.where("on"))
            break
        key = "sequence_id"
    columns = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    parts = [d.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), *columns) for d in done]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
