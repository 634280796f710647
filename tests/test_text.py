"""Line sources and scalar text functions."""

import os

import pytest
from pyspark.sql import functions as F

from transvoc.functions.text import first_half, py_strip, second_half
from transvoc.sources.corpus import (read_corpus, read_devtest, read_training_lines,
                                     strip_file_edges)


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col("x").alias("y")).first()["y"]


def test_strip_matches_python(spark):
    for s in ["  a b\t", "\x1c\x1dtext\x1f", "  ", "", "x", " y　", "in  ner"]:
        assert one(spark, py_strip, s) == s.strip()


def test_halves_by_code_point(spark):
    for s in ["abcde", "a\U0001F600b\U0001F600c", "x", "", "éé"]:
        assert one(spark, first_half, s) == s[: len(s) // 2]
        assert one(spark, second_half, s) == s[len(s) // 2:]


def test_corpus_order_across_splits(spark, tmp_dir):
    lines = [f"line {i:05d} " + "x" * (i % 13) for i in range(3000)]
    with open(os.path.join(tmp_dir, "xx.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # many splits
    try:
        df = read_corpus(spark, tmp_dir)
        got = [r["line"] for r in df.orderBy("line_no").collect()]
        assert df.select("lang").distinct().first()["lang"] == "xx"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [s.strip() for s in lines]


def test_devtest_unicode_breaks(spark, tmp_dir):
    text = "a b\n c\x85d \n\x0be\n"
    with open(os.path.join(tmp_dir, "yy.devtest"), "w", encoding="utf-8") as f:
        f.write(text)
    got = [r["line"] for r in read_devtest(spark, tmp_dir).orderBy("line_no").collect()]
    assert got == [x.strip() for x in text.splitlines()]
    plain = [r["line"] for r in read_corpus(spark, tmp_dir, glob="*.devtest").orderBy("line_no").collect()]
    assert len(plain) == 3


def test_training_file_strip(spark, tmp_dir):
    texts = ["\n\n  first\n  inner  \n\n last  \n\n", "   \n \n", "only"]
    paths = []
    for i, t in enumerate(texts):
        p = os.path.join(tmp_dir, f"f{i}.txt")
        with open(p, "w") as f:
            f.write(t)
        paths.append(p)
    df = read_training_lines(spark, paths)
    got = [[r["line"] for r in df.filter(F.col("file_ord") == i).orderBy("line_no").collect()]
           for i in range(len(texts))]
    assert got == [t.strip().split("\n") for t in texts]


def test_strip_file_edges_on_rows(spark):
    rows = [("f", 0, " "), ("f", 1, "  a "), ("f", 2, " "), ("f", 3, " b  "), ("f", 4, "")]
    df = spark.createDataFrame(rows, "file string, line_no int, raw string")
    got = [r["line"] for r in strip_file_edges(df, ["file"]).orderBy("line_no").collect()]
    assert got == "\n".join(r[2] for r in rows).strip().split("\n")


def test_read_mcq_coerces_and_checks_count(spark, tmp_dir):
    import json

    import pytest

    from transvoc.sources.mcq import read_mcq
    items = [{"flores_passage": "p", "question": "q", "mc_answer1": "a", "mc_answer2": "b",
              "mc_answer3": "c", "mc_answer4": "d", "correct_answer_num": v}
             for v in (2, "3", "1")]
    with open(os.path.join(tmp_dir, "items.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in items) + "\n")
    got = read_mcq(spark, tmp_dir, expect=3).orderBy("item_id").collect()
    assert [r["correct"] for r in got] == [2, 3, 1]
    assert [r["item_id"] for r in got] == [0, 1, 2]
    assert list(got[0]["answers"]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="expected 900"):
        read_mcq(spark, tmp_dir, expect=900)


def test_format_stat_and_missing(spark):
    from transvoc.operators.report import format_stat
    df = spark.createDataFrame([(1.23456, 0.5), (None, None)], "m double, s double")
    got = [r[0] for r in df.select(format_stat("m", "s")).collect()]
    assert got == ["1.235 (std=0.500)", "N/A"]


def test_training_files_by_place_in_the_list(spark, tmp_dir):
    """Escaped paths, an empty file, one listed twice, one path the end of another."""
    os.makedirs(os.path.join(tmp_dir, "sub"))
    files = {"a b%.txt": " x \ny", "empty.txt": "", "c.txt": "c", "sub/c.txt": "\n sub c"}
    for name, text in files.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    order = ["c.txt", "a b%.txt", "empty.txt", "sub/c.txt", "a b%.txt"]
    df = read_training_lines(spark, [os.path.join(tmp_dir, n) for n in order])
    got = [[r["line"] for r in df.filter(F.col("file_ord") == i).orderBy("line_no").collect()]
           for i in range(len(order))]
    assert got == [files[n].strip().split("\n") for n in order]


def test_devtest_order_with_many_breaks(spark, tmp_dir):
    text = " ".join(str(i) for i in range(3000)) + "\nlast\x0bone"
    with open(os.path.join(tmp_dir, "xx.devtest"), "w") as f:
        f.write(text)
    rows = read_devtest(spark, tmp_dir).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == [*map(str, range(3000)), "last", "one"]


def test_malformed_json_fails(spark, tmp_dir):
    from transvoc.sources.mcq import read_mcq
    from transvoc.sources.metrics_json import read_metrics
    for name, text in (("m", '{"en": {"fr": {"fvt": {"src_bpt": 1.0'), ("q", '{"question": "a", ')):
        os.makedirs(os.path.join(tmp_dir, name))
        with open(os.path.join(tmp_dir, name, "x.json"), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_metrics(spark, {"r": os.path.join(tmp_dir, "m")}).collect()
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_mcq(spark, os.path.join(tmp_dir, "q")).collect()
