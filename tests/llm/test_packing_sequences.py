"""Packed sequences: the library's ids, gapless places, few sequences, every kind of exchange."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from transvoc.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_places(rows, capacity):
    """Every sequence is gapless from 0 and no longer than the capacity."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_ids_equal_the_library(library):
    known, r = packing.PartIds(PATH), random.Random(2)
    letters = "aAbB'sStTreREdDlLvVmM09²½ \t\n\x1c\x1f\x00\x7f\x85\xa0éÉÀßÿµªΣσςİIı漢🙂́ ​.,!<|>ẞﬁÅǅ﻿"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(6000)]
    texts += ["<|endoftext|> a", "don't DON'T we'RE 'twas", "Å ́x", "x" * 5000, "é" * 3000, ""]
    for text in texts:
        assert np.frombuffer(known.of_text(text), "<u4").tolist() == ids_of(library, text)[:-1], text


def test_remembers_a_bounded_number(library, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 3)
    known = packing.PartIds(PATH)
    assert np.frombuffer(known.of_text("one two three four one five"), "<u4").tolist() == \
        ids_of(library, "one two three four one five")[:-1]
    assert len(known) <= 3


@pytest.mark.parametrize(("bins", "after"), [
    ([[5, 4], [1]], [[5, 4, 1]]),                          # a move empties the bin
    ([[8], [3, 4], [3]], [[8], [3, 4, 3]]),
    ([[6, 3], [4], [7, 2]], None),                         # one for one: 4 for 3
    ([[5, 4], [3, 2, 1]], None)])
def test_exchanges(bins, after):
    lengths = np.array([n for b in bins for n in b])
    of = np.array([i for i, b in enumerate(bins) for _ in b])
    search = packing.Search(lengths, of.copy(), 10)
    squares = int((search.fill ** 2).sum())
    found = search.run()
    fill = np.bincount(found, weights=lengths)
    assert fill.max() <= 10 and (fill ** 2).sum() >= squares
    if after:
        got = [sorted(lengths[found == b].tolist()) for b in np.unique(found)]
        assert sorted(got) == sorted(map(sorted, after))


@pytest.mark.parametrize(("kind", "donor", "others", "step"), [
    ("one for one", [4], [[6, 3]], ([4], 1, [3])),
    ("two for one", [2, 2], [[6, 3]], ([2, 2], 1, [3])),
    ("one for two", [5], [[5, 2, 2]], ([5], 1, [2, 2]))])
def test_each_kind_of_exchange(kind, donor, others, step):
    lengths = np.array(donor + [n for b in others for n in b])
    of = np.array([0] * len(donor) + [i + 1 for i, b in enumerate(others) for _ in b])
    search = packing.Search(lengths, of, 10)
    search._underfull()
    given, taker, taken = search._best(0)
    assert (sorted(lengths[given].tolist()), taker, sorted(lengths[taken].tolist())) == step, kind


def test_every_exchange_raises_the_squares(monkeypatch):
    r = random.Random(5)
    for _ in range(30):
        lengths = np.array([r.randint(1, 99) for _ in range(120)])
        of = np.array(packing.best_fit(lengths.tolist(), 100))
        search, exchange = packing.Search(lengths, of, 100), packing.Search._exchange

        def step(self, *a, exchange=exchange):
            before = int((self.fill ** 2).sum())
            exchange(self, *a)
            assert int((self.fill ** 2).sum()) > before and self.fill.max() <= 100

        monkeypatch.setattr(packing.Search, "_exchange", step)
        first = len(np.unique(of))
        out = search.run()
        monkeypatch.setattr(packing.Search, "_exchange", exchange)
        assert search.least <= len(np.unique(out)) <= first
        assert (np.bincount(out, weights=lengths, minlength=first) == search.fill).all()


def test_search_removes_bins_that_best_fit_leaves():
    r = random.Random(7)
    lengths = np.array([r.randint(1, 1500) for _ in range(4000)])
    of = packing.best_fit(lengths.tolist(), 2048)  # in the order they come
    out = packing.Search(lengths, of.copy(), 2048).run()
    least = -(-int(lengths.sum()) // 2048)
    assert len(np.unique(out)) - least <= (len(np.unique(of)) - least) / 2


def brute(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = [len(lengths)]

    def place(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(fills)
            return
        for j in range(len(fills)):
            if fills[j] + lengths[i] <= capacity:
                fills[j] += lengths[i]
                place(i + 1, fills)
                fills[j] -= lengths[i]
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best[0]


def test_near_the_fewest():
    r, more = random.Random(11), 0
    for _ in range(60):
        lengths = [r.randint(1, 20) for _ in range(9)]
        order = sorted(lengths, reverse=True)
        out = packing.Search(np.array(order), packing.best_fit(order, 24), 24).run()
        more += len(np.unique(out)) - brute(order, 24)
    assert more <= 2


@pytest.mark.parametrize(("capacity", "group"), [(2048, packing.GROUP), (16, 4), (64, 3)])
def test_operator(spark, clashing, library, capacity, group):
    names = ["doc_id", "text", "row", "n_tokens"]
    more = clashing.withColumns({c: F.lit("x") for c in ("piece", "number", "length", "sequence_id", "group", "on")})
    rows = packing.pack(more, PATH, keep=tuple(names), capacity=capacity, group=group).collect()
    want = []
    for r in clashing.collect():
        ids = ids_of(library, r.text)
        want += [(r.doc_id, k, at, len(ids[at:at + capacity]), crc(ids[at:at + capacity]))
                 for k, at in enumerate(range(0, len(ids), capacity))]
    key = lambda x: tuple((v is None, v) for v in x)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    used = check_places(rows, capacity)
    assert used <= -(-sum(w[3] for w in want) // capacity) * 1.1 + 2
    assert {(r.row, r.n_tokens) for r in rows} == {("r", 4)}


def test_levels_join_what_groups_leave(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(["a"] * r.randint(0, 700))) for i in range(600)],
                                 "doc_id long, text string")
    rows = packing.pack(docs, PATH, capacity=1000, group=32).collect()
    used, tokens = check_places(rows, 1000), sum(x.length for x in rows)
    assert len(rows) == 600 and used <= 1.03 * tokens / 1000  # 19 groups alone would leave one each


def test_empty_table(spark, no_docs):
    out = packing.pack(no_docs, PATH)
    assert out.collect() == []
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
