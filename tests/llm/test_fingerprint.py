"""Bottom-k fingerprints: estimates against true sets, merging, the next document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from transvoc.llm import fingerprint as P
from transvoc.llm import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_edited(rows):
    """(id, text, edited, next) in descending order of ids, by the definition."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        out.append((k, t, t[:len(t) - cut] + nxt[:cut], nxt))
    return out


def test_exact_below_k(spark):
    rows = [(" ".join(f"w{i}" for i in range(n)), " ".join(f"w{i}" for i in range(m, n + m)))
            for n, m in ((60, 0), (60, 20), (6, 1), (3, 0), (0, 0), (40, 100), (0, 5))]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = P.sketch(F.col("a")), P.sketch(F.col("b"))
    got = df.select("a", "b", P.resemblance(a, b).alias("r"), P.distinct_count(a).alias("n"),
                    P.containment(a, b).alias("c"), P.as_text(a).alias("t")).collect()
    for r in got:
        x, y = shingles(r["a"]), shingles(r["b"])
        assert r["r"] == pytest.approx(likeness(x, y)) and r["n"] == len(x)
        assert r["c"] == pytest.approx(len(x & y) / len(x) if x else 1.0) and len(r["t"]) == 12 * len(x)


def test_estimates(spark):
    rng = random.Random(1)
    rows = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(8):
            words = [f"x{rng.randrange(10**9)}" for _ in range(2000)]
            other = words[:int(2000 * share)] + [f"y{rng.randrange(10**9)}" for _ in range(2000 - int(2000 * share))]
            rows.append((share, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "share double, a string, b string")
    a, b = P.sketch(F.col("a")), P.sketch(F.col("b"))
    got = df.select("share", "a", "b", P.resemblance(a, b).alias("r"), P.distinct_count(a).alias("n"),
                    P.containment(a, b).alias("c")).collect()
    for r in got:
        x, y = shingles(r["a"]), shingles(r["b"])
        assert abs(r["r"] - likeness(x, y)) < 0.2 and abs(r["n"] / len(x) - 1) < 0.45
        assert abs(r["c"] - len(x & y) / len(x)) < 0.25


def test_merge(spark):
    left, right = " ".join(f"l{i}" for i in range(300)), " ".join(f"r{i}" for i in range(300))
    df = spark.createDataFrame([(left, right)], "a string, b string")
    a, b = P.shingle_hashes(F.col("a")), P.shingle_hashes(F.col("b"))
    row = df.select(P.merge(P.bottom_k(a), P.bottom_k(b)).alias("m"), P.bottom_k(F.concat(a, b)).alias("w")).first()
    assert row["m"] == row["w"] and len(row["m"]) == P.K


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_with_next(spark, monkeypatch, clashing, range_rows):
    monkeypatch.setattr(P, "RANGE_ROWS", range_rows)
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()] + [(k, f"text of {k}") for k in
                                                                     (-5, 2**62, -2**63, 50, 51, 52, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash"))
    got = P.with_next(df, {"size": F.length("text")}).select(
        "doc_id", "text", P.replace_tail(F.col("text"), F.col("next.text")).alias("e"), "next").collect()
    want = plain_edited(rows)
    assert sorted(((r["doc_id"], r["text"], r["e"], r["next"]["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["next"]["size"] == len(r["next"]["text"]) for r in got)


def test_single_and_empty(spark, no_docs):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    row = P.with_next(one, {"s": P.sketch(F.col("text"))}).first()
    assert row["next"]["text"] == "abcdef"
    assert P.with_next(no_docs, {}).collect() == []


def test_query(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 20)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = {r["doc_id"]: r for r in queries.op10_fingerprint(spark, SF).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for k, text, edited, nxt in plain_edited(docs):
        r = rows[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(shingles(text), shingles(edited))) < 0.25
        assert abs(r["near_next"] - likeness(shingles(text), shingles(nxt))) < 0.25
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if edited == text:
            assert r["edited_fingerprint"] == r["fingerprint"] and r["near_edited"] == 1.0
