"""Reversed search: equal to scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from transvoc.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def plain(docs, items, top=10):
    """Rankings by definition: (item, rank, doc, score)."""
    counted = [(d, c) for d, c in ((d, terms(t)) for d, t in docs) if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 100 - 75 + 75 * c.total() * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in terms(text).items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, parts=3, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string")
    out = lexical.search(d, i, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def random_texts(n, words, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ünï", "漢字", "The", "THE", "x1_y", "a.b", "🙂"]
    return [(i, " ".join(r.choice(vocabulary[:r.randint(1, len(vocabulary))]) for _ in range(r.randint(0, words))))
            for i in range(n)]


@pytest.mark.parametrize("top", [1, 3, 10])
def test_equals_scoring_everything(spark, top):
    docs, items = random_texts(200, 60, 1), random_texts(25, 15, 2)
    assert result(spark, docs, items, top=top) == plain(docs, items, top)


@pytest.mark.parametrize("index_terms", [1, 20, 90])
def test_blocks_of_items(spark, index_terms):
    docs, items = random_texts(60, 30, 3), random_texts(9, 12, 4)
    assert result(spark, docs, items, index_terms=index_terms) == plain(docs, items)


def test_steps_cover_every_document(monkeypatch):
    import pyarrow as pa
    rows = [{"item": 0, "terms": [b"a", b"b"], "counts": [1, 2]}, {"item": 1, "terms": [b"a"], "counts": [1]}]
    index = lexical.Index(rows)
    lists = [[0, 1], [], [0], [1], [], [0, 1], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([3] * 7), pa.array(lists, pa.list_(pa.int32()))],
                                       names=["key", "n", "terms"])
    for cells in (1, 2, 3, 6, 100):
        monkeypatch.setattr(lexical, "CELLS", cells)
        steps = list(lexical._steps(batch, index))
        assert [a for a, _ in steps] == [sum(n for _, n in steps[:i]) for i in range(len(steps))]
        assert sum(n for _, n in steps) == 7


def test_awkward_rows(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (None, None), (3, None),
            (4, ""), (5, " .,;"), (6, "gamma " * 30_000), (7, "x" * 50_000), (8, "ALPHA-beta_GAMMA"), (-9, "alpha"),
            (10, "été ÉTÉ"), (11, "a\x00b\x7fc")]
    items = [(1, "Alpha alpha BETA"), (2, None), (3, ""), (4, "nothing of it"), (5, "gamma"), (None, "beta"),
             (1, "Alpha alpha BETA"), (6, "été b"), (7, "x" * 50_000)]
    assert result(spark, docs, items) == plain(docs, items)


def test_ties_by_key(spark):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (99, "other")]
    got = result(spark, docs, [(1, "words")], parts=7)
    assert got == plain(docs, [(1, "words")])
    assert sorted(r[2] for r in got) == list(range(1, 11))


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")]),
                                             ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert result(spark, docs, items) == []


def test_clashing_columns(spark):
    docs, items = random_texts(40, 20, 5), random_texts(5, 8, 6)
    names = ("key", "n", "terms", "counts", "item", "rank", "score", "salt", "item_id")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in names})
    i = (spark.createDataFrame(items, "item_id long, text string")
         .withColumns({c: F.lit("x") for c in (*names[:-1], "doc_id")}))
    assert sorted(map(tuple, lexical.search(d, i).collect()), key=str) == plain(docs, items)


def test_key_must_be_a_number(spark):
    d = spark.createDataFrame([("a", "word")], "doc_id string, text string")
    i = spark.createDataFrame([(1, "word")], "item_id long, text string")
    with pytest.raises(ValueError, match="whole number"):
        lexical.search(d, i)
