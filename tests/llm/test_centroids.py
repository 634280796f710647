"""Clusters by bit planes: equal to plain integer arithmetic."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transvoc.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16, rounds=3):
    """Clusters by definition, with Python integers."""
    kept = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((kv for kv in kept if kv[0] is not None),
                   key=lambda kv: hashlib.sha256(f"1:{kv[0]}".encode()).hexdigest())
    own = [list(v) for _, v in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v: min((apart(v, c), j) for j, c in enumerate(own))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        for j, vs in groups.items():
            own[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    return sorted(((i, best(v)[1], best(v)[0], own[best(v)[1]]) for i, v in kept), key=str)


def random_rows(n, spread, seed=3):
    r = random.Random(seed)
    hubs = [[r.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    return [(i, [x + r.gauss(0, spread / 4) for x in r.choice(hubs)]) for i in range(n)]


def result(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    out = centroids.cluster(df, **how)
    return sorted(((r.vec_id, r.cluster, r.distance, r.centroid) for r in out.collect()), key=str), out


@pytest.mark.parametrize("spread", [0.01, 0.3, 5000.0])
def test_equals_plain_arithmetic(spark, spread):
    rows = random_rows(150, spread)
    got, out = result(spark, rows)
    assert got == plain(rows)
    total = sum(r[2] for r in got)
    assert {r.inertia for r in out.collect()} == {total}
    for r in out.collect():
        assert r.cluster_inertia == sum(g[2] for g in got if g[1] == r.cluster)


def test_awkward_vectors(spark):
    ok = random_rows(20, 0.3)
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [0.5] * 63),
           (105, [float("nan")] + [0.5] * 63), (106, [float("inf")] * 64), (107, [float("-inf")] + [0.0] * 63)]
    rows = ok + bad + [ok[0], ok[0], (None, ok[1][1]), (50, ok[2][1]), (51, [0.0] * 64), (52, [-0.0] * 64)]
    assert result(spark, rows)[0] == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = random_rows(n, 0.3) + [(90, None)]
    got, out = result(spark, rows)
    assert got == plain(rows)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_clashing_columns(spark):
    rows = random_rows(30, 0.3)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    names = ("row", "planes", "norm", "cluster", "distance", "n", "sums", "centroid", "vector", "digest", "inertia")
    more = df.withColumns({c: F.lit("x") for c in names})
    assert sorted(centroids.cluster(more).collect()) == sorted(centroids.cluster(df).collect())
    kept = centroids.cluster(df.withColumn("row", F.lit("x")), keep=("label", "row"))
    assert {(r.label, r.row) for r in kept.collect()} == {(0, "x")}


def test_too_large(spark):
    with pytest.raises(Exception, match="in size"):
        result(spark, [(1, [3e6] * 64)])


def test_planes_hold_any_integer():
    r = np.random.default_rng(1)
    for most in (1, 2, 63, 64, 65, 2**20, 2**27 - 1):
        x = r.integers(-most, most + 1, (40, 64))
        y = r.integers(-3, 4, (7, 64))
        a, b = centroids.to_planes(x), centroids.to_planes(y)
        assert (centroids.from_planes(a) == x).all()
        assert (centroids.dot_products(a, b) == x @ y.T).all()
        assert (centroids.squared_norms(a) == (x * x).sum(axis=1)).all()
