"""Byte-budget sampler and the two-level prefix sum against their definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from transvoc.operators.prefix import doc_block, exclusive_prefix_sum
from transvoc.operators.sampling import byte_budget_split, premiums


def defined_split(lines, train, valid):
    """Train: lines whose preceding bytes are within the train budget.  Valid: of the
    others, those whose preceding bytes, counted from the first of them, are within
    the valid budget."""
    sizes = [len(line.encode("utf-8")) for line in lines]
    before = [0, *itertools.accumulate(sizes)]
    first = next((i for i in range(len(lines)) if before[i] > train), len(lines))
    last = next((i for i in range(first, len(lines)) if before[i] - before[first] > valid), len(lines))
    return [(i, "train" if i < first else "valid") for i in range(last)]


def run(spark, lines, train, valid, lang="xx", factor=1.0, block=2):
    rows = [(lang, i // 3, i % 3, s) for i, s in enumerate(lines)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, line string")
    prem = premiums(spark, {lang: factor})
    res = byte_budget_split(df, prem, train, valid, docs_per_block=block)
    got = sorted((r["doc_id"] * 3 + r["line_no"], r["split"]) for r in res.collect())
    return got


def test_overshoot(spark):
    got = run(spark, ["aaaaaa"] * 4, 10, 0)
    assert got == [(0, "train"), (1, "train"), (2, "valid")]


def test_equality_is_inclusive(spark):
    got = run(spark, ["aaaaaa"] * 3, 6, 6)
    assert got == [(0, "train"), (1, "train"), (2, "valid")]


def test_blank_lines_kept(spark):
    lines = ["abc", "", "de", "", "fghij", "", "k"]
    assert run(spark, lines, 4, 3) == defined_split(lines, 4, 3)


def test_missing_premium_names_language(spark):
    df = spark.createDataFrame([("zz", 0, 0, "a")], "lang string, doc_id long, line_no int, line string")
    with pytest.raises(KeyError, match="zz"):
        byte_budget_split(df, premiums(spark, {"xx": 1.0}), 10, 10).collect()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_sequential(spark, seed):
    rnd = random.Random(seed)
    lines = ["é" * rnd.randint(0, 9) + "x" * rnd.randint(0, 5) for _ in range(60)]
    for block in (1, 4, 50):
        assert run(spark, lines, 80, 30, block=block) == defined_split(lines, 80, 30)


def test_prefix_sum_independent_of_blocks_and_partitions(spark):
    rnd = random.Random(7)
    rows = [("a" if i % 3 else "b", i * i, 0, rnd.randint(0, 100)) for i in range(300)]  # ids of any density
    df = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, v long")
    expect, acc = {}, {}
    for lang, d, _, v in rows:
        expect[(lang, d)] = acc.get(lang, 0)
        acc[lang] = acc.get(lang, 0) + v
    for block, parts in ((1, 1), (7, 3), (1000, 5), (10**6, 2)):
        out = exclusive_prefix_sum(df.repartition(parts), ["lang"], doc_block("doc_id", block),
                                   ["doc_id", "line_no"], "v")
        got = {(r["lang"], r["doc_id"]): r["before"] for r in out.collect()}
        assert got == expect


@pytest.mark.parametrize("train,valid", [(0, 0), (150, 40), (700, 300), (10**6, 5), (2600, 10**6)])
def test_labels_without_places_are_the_same(spark, train, valid):
    """Blocks inside a budget are labelled whole; only lines of the others are dealt by block."""
    rnd = random.Random(train + valid)
    rows = [(lang, doc, n, "x" * rnd.choice((0, 0, 1, 7, 30))) for lang in ("en", "de", "fr") for doc in range(-20, 90)
            if rnd.random() < 0.7 for n in range(rnd.randint(1, 3))]
    lines = spark.createDataFrame(rows + [("en", None, 0, "xyz")], "lang string, doc_id long, line_no int, line string").repartition(5)
    prem = premiums(spark, {"en": 1.0, "de": 0.5, "fr": 1.25})
    want = byte_budget_split(lines, prem, train, valid, docs_per_block=8)
    got = byte_budget_split(lines, prem, train, valid, docs_per_block=8, places=False)
    shown = lambda df: sorted(map(str, df.select("lang", "doc_id", "line_no", "line", "bytes", "split").collect()))
    assert "before" not in got.columns and shown(got) == shown(want) != []
    whole = got._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1].split("\n:- ", 1)[1].split("\n+- ", 1)[0]
    assert "Window" not in whole and "Aggregate" not in whole
