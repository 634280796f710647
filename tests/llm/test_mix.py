"""Mixing: targets against water filling, words near the targets, no document beyond its copies."""

import pytest
from pyspark.sql import functions as F

from transvoc.llm import mix, queries

SF = "/root/testdata/sf0.001"


def water_filling(sizes, share, most, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if sizes[s] * most <= level * w[s]]
        if not full:
            target.update({s: level * w[s] for s in open_})
            break
        for s in full:
            target[s] = sizes[s] * most
            left -= target[s]
            open_.discard(s)
    return target


def checked(rows, most=2):
    sizes, largest, taken, target = {}, {}, {}, {}
    for r in rows:
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        largest[s] = max(largest.get(s, 0), r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= most
    want = water_filling(sizes, 1.5, most)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    return sizes, taken, target


def sized(spark, n, sources):
    rows = [(i, sources[i % len(sources)] if i % 3 else sources[0], 1 + (i * 7919) % 400) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


@pytest.mark.parametrize("bucket_docs,broadcast", [(4096, 100_000), (8, 100_000), (8, 0)])
def test_targets_and_words(spark, monkeypatch, bucket_docs, broadcast):
    monkeypatch.setattr(mix, "BUCKET_DOCS", bucket_docs)
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", broadcast)
    docs = sized(spark, 1500, ["hot", "b", None, "ä", "Z", "c"])
    rows = mix.mix(docs, size=F.col("size")).collect()
    assert len(rows) == 1500
    sizes, taken, target = checked(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 1


def test_reruns_agree_whatever_the_partitions(spark):
    docs = sized(spark, 600, ["a", "b", "c"])
    one = {r["doc_id"]: r["copies"] for r in mix.mix(docs.repartition(1), size=F.col("size")).collect()}
    two = {r["doc_id"]: r["copies"] for r in mix.mix(docs.repartition(7), size=F.col("size")).collect()}
    other = {r["doc_id"]: r["copies"] for r in mix.mix(docs, size=F.col("size"), seed=5).collect()}
    assert one == two and one != other


def test_order_is_by_odds(spark):
    """In a source, the documents taken are those of least ratio of odds, but for the last places."""
    docs = sized(spark, 400, ["a", "b", "c"])
    rows = mix.mix(docs, size=F.col("size")).withColumn("u", mix.draw([F.col("doc_id")], 17)).collect()
    for s in ("a", "b", "c"):
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["u"])
        if len({r["copies"] for r in own}) < 2:
            continue
        most = max(r["copies"] for r in own)
        prefix = next(i for i, r in enumerate(own) if r["copies"] < most)
        extra = sum(r["copies"] == most for r in own[prefix:])
        assert prefix > 0 and extra <= mix.LAST_PLACES + 1


def tied(spark, n, key, text):
    rows = [(key(i), "a", text(i), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, note long")


@pytest.mark.parametrize("key", [lambda i: None, lambda i: 7, lambda i: i // 300])
@pytest.mark.parametrize("text", [lambda i: "w " * 10, lambda i: f"w{i} " * (1 + i % 19), lambda i: f"w{i % 3} " * 10])
def test_equal_keys_come_near_the_target(spark, key, text):
    """Null or repeated ids, with equal or different texts: as many rows are taken as the target holds."""
    docs = tied(spark, 1000, key, text)
    runs = []
    for parts in (1, 7):
        rows = mix.mix(docs.repartition(parts), size=queries.n_words(F.col("text")), keys=("doc_id", "text")).collect()
        assert len(rows) == 1000
        _, taken, target = checked(rows)
        assert abs(taken["a"] - target["a"]) <= 20 and target["a"] == pytest.approx(1.5 * rows[0]["source_size"])
        runs.append(sorted(rows, key=str))
        # Every row is still there.
        assert sorted((r["doc_id"] or -1, r["text"], r["note"]) for r in rows) == sorted(
            (key(i) or -1, text(i), i % 2) for i in range(1000))
    assert runs[0] == runs[1]


def test_weights_of_documents(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", 10, 3.0 if i % 4 == 1 else 1.0) for i in range(800)],
                                 "doc_id long, source string, size long, w double")
    rows = mix.mix(docs, size=F.col("size"), weight="w", weights=(1, 3)).collect()
    heavy = [r["copies"] for r in rows if r["w"] == 3.0]
    light = [r["copies"] for r in rows if r["source"] == "a" and r["w"] == 1.0]
    assert sum(heavy) / len(heavy) > 1.5 * sum(light) / len(light)


def test_edges(spark, edge_docs, no_docs, clashing):
    for docs in (edge_docs, clashing):
        rows = mix.mix(docs, size=queries.n_words(F.col("text"))).collect()
        assert len(rows) == 13
        checked(rows)
    assert mix.mix(no_docs, size=queries.n_words(F.col("text"))).collect() == []
    blank = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert {r["taken"] for r in mix.mix(blank, size=F.col("size")).collect()} == {0}


def test_query(spark):
    got = queries.op3_mix_sources(spark, SF)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r.asDict() | {"source": docs[r["doc_id"]]["source"]} for r in got.collect()]
    assert len(rows) == len(docs)
    sizes, _, _ = checked(rows)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]["text"].encode().split()) and r["source_size"] == sizes[r["source"]]
