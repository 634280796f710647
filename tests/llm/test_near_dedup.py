"""Near duplicates against brute force, and the sketch against its definition."""

import random

import numpy as np
import pytest

from transvoc.llm import near_dedup as N
from transvoc.llm import queries

SF = "/root/testdata/sf0.001"


def plain_set(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """(n, component, kept) of each (id, text), links by the definition."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[root(i)] = min(ids.get(root(i), k), k)
    out = []
    for i, (k, _) in enumerate(rows):
        c = ids.get(root(i)) if sets[i] else k
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                   for r in N.near_duplicates(df).collect()), key=str)


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("small,hubs", [(N.BROADCAST_ROWS, 64), (0, 2)])
def test_group_of_near_copies(spark, monkeypatch, small, hubs):
    """A large group with all degrees of likeness, a chain, a family on a common passage."""
    monkeypatch.setattr(N, "BROADCAST_ROWS", small)
    monkeypatch.setattr(N, "HUBS", hubs)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(base, rng.randrange(0, 9), rng) for _ in range(70)]
    chain = [f"c{i}" for i in range(160)]
    texts += [" ".join(chain[3 * i:3 * i + 100]) for i in range(20)]
    texts += [" ".join([f"p{i}" for i in range(40)] + [f"q{j}_{i}" for i in range(25)]) for j in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op4_near_dedup(spark, SF)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)


def test_threshold_is_exact(spark):
    """Three of four shingles linked, one less not."""
    words = [f"t{i}" for i in range(30)]
    rows = [(1, " ".join(words[:16])), (2, " ".join(words[3:16])),      # 12 shingles, 9 of them: 75 %
            (3, " ".join(f"s{i}" for i in range(16))), (4, " ".join(f"s{i}" for i in range(4, 16)))]  # 8 of 12
    found = {r[0]: r[2] for r in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_edges(spark, edge_docs, no_docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(edge_docs) == brute(rows) == got(clashing)
    assert got(no_docs) == []
    one = N.keep_one(clashing)
    assert one.columns == clashing.columns
    kept = one.select("doc_id", "text").collect()
    texts = [r["text"] for r in kept if plain_set(r["text"])]
    assert len(texts) == len(set(texts)) and {r["doc_id"] for r in kept} == {1, 3, 4, 5, 6, 7, 8, None, 9, 10}
    assert N.keep_one(no_docs).count() == 0


def test_upper_case_only_ascii(spark):
    rows = [(1, "ÄB c d e f g"), (2, "äb c d e f g"), (3, "ÄB C D E F G")]
    found = {r[0]: r[2] for r in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert found == {1: 1, 2: 2, 3: 1}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 3000):
        assert (N.similarity_sketch(rng.integers(0, 2**63, n).astype(np.uint64)) < np.uint64(2**63)).all()
    for share in (0.3, 0.75, 0.95):
        seen = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, 400).astype(np.uint64)
            both = int(400 * share)
            a, b = pool[:both + (400 - both) // 2], np.concatenate([pool[:both], pool[both + (400 - both) // 2:]])
            seen.append((N.similarity_sketch(a) == N.similarity_sketch(b)).mean())
        assert abs(np.mean(seen) - share) < 0.03


def test_packed_agreement(spark):
    rng = np.random.default_rng(1)
    a = N.similarity_sketch(rng.integers(0, 2**63, 500).astype(np.uint64))
    b = a.copy()
    b[::3] = N.similarity_sketch(rng.integers(0, 2**63, 500).astype(np.uint64))[::3]
    x, y = N.packed_bytes(a), N.packed_bytes(b)
    want = sum(((int(x[i]) >> 8 * k) & 255) == ((int(y[i]) >> 8 * k) & 255)
               for i in range(len(x)) for k in range(N.PACKED))
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "a array<long>, b array<long>")
    assert df.select(N.agreeing(F.col("a"), F.col("b"))).first()[0] == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(60)] + [(7, 7)]
    tables = N.Scratch(spark, "test")
    labels = N.components(spark.createDataFrame(edges, "u long, v long"), tables)
    found = {r["node"]: r["up"] for r in labels.collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and {found[v] for _, v in edges[60:-1]} == {100}
    assert N.components(spark.createDataFrame([(3, 3)], "u long, v long"), tables) is None
