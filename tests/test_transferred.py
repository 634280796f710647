"""Transferred models against dense matrices, and their scores against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transvoc.operators import product
from transvoc.operators import transferred as TM


def triples(m):
    i, j = np.nonzero(m)
    return i, j, m[i, j]


@pytest.mark.parametrize("chunk", [1, 7, 10**6])
def test_product_equals_dense(monkeypatch, chunk):
    monkeypatch.setattr(product, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    W = rng.normal(size=(12, 9)) * (rng.random((12, 9)) < 0.5)
    C = rng.integers(0, 5, (9, 9)).astype(float)
    p, t = np.array([0, 3, 3, 11, 7]), np.array([2, 2, 5, 11, 0])
    got = product.multiply(triples(W), triples(C), triples(W), (p, t))
    assert np.allclose(got, (W @ C @ W.T)[p, t])
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    assert product.multiply(empty, triples(C), triples(W), (p, t)).tolist() == [0.0] * 5
    assert len(product.multiply(triples(W), empty, empty, (p[:0], t[:0]))) == 0


@pytest.mark.parametrize(("block", "shard"), [(1, 1), (3, 10), (1000, 10**6)])
def test_sampled_product_of_groups(spark, block, shard):
    rng = np.random.default_rng(5)
    frames, want = {"w": [], "c": [], "p": []}, {}
    for g in ("x", "y"):
        W = rng.normal(size=(10, 6)) * (rng.random((10, 6)) < 0.6)
        C = rng.integers(0, 3, (6, 6)).astype(float)
        frames["w"] += [(g, int(i), int(j), float(v)) for i, j, v in zip(*triples(W), strict=True)]
        frames["c"] += [(g, int(i), int(j), int(v)) for i, j, v in zip(*triples(C), strict=True)]
        places = {(int(a), int(b)) for a, b in rng.integers(0, 10, (25, 2))}
        frames["p"] += [(g, a, b) for a, b in places]
        want |= {(g, a, b): (W @ C @ W.T)[a, b] for a, b in places}
    out = product.sampled_product(
        spark.createDataFrame(frames["w"], "g string, row int, col int, w double"),
        spark.createDataFrame(frames["c"], "g string, a int, b int, n long"),
        spark.createDataFrame(frames["p"], "g string, p int, t int"), ["g"], block, shard).collect()
    got = {(r.g, r.p, r.t): r.c for r in out}
    assert set(got) <= set(want)
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-9) for k, v in want.items())


VOCAB = [("s", "ab", 4), ("s", "a", 5), ("s", "b", 6), ("t", "ab", 4), ("t", "ba", 5), ("t", "q", 6), ("t", "b", 7)]


@pytest.fixture(scope="module")
def small(spark):
    vocab = spark.createDataFrame(VOCAB, "lang string, token string, id int")
    rebuilt = spark.createDataFrame([("s", "t", "ba", 5, ["ab", "b"], [2.0, -0.5]), ("s", "t", "q", 6, [], [])],
                                    "src_lang string, tgt_lang string, token string, tgt_id int, "
                                    "support array<string>, coefs array<double>")
    return vocab, TM.transferred_weights(vocab, vocab, rebuilt)


def test_weights(small):
    got = {}
    for r in small[1].where("src_lang = 's'").collect():
        got.setdefault((r.method, r.id), {})[r.sid] = r.w
    both = {1: {1: 1.0}, 2: {2: 1.0}, 4: {4: 1.0}, 7: {6: 1.0}}   # specials, ab and b as they are
    assert {k[1]: v for k, v in got.items() if k[0] == "fvt"} == both | {5: {5: 0.5, 6: 0.5}, 6: {1: 1.0}}
    assert {k[1]: v for k, v in got.items() if k[0] == "omp"} == both | {5: {4: 2.0, 6: -0.5}}  # q has no anchor


def test_counts_are_cut_to_their_context(spark, small):
    weights = small[1].where("src_lang = 's'")
    lm = spark.createDataFrame([("s", 2, 4, 6), ("s", 4, 6, 8), ("s", 6, 6, 1), ("s", 4, 1, 3)],
                               "lang string, prev int, tok int, n long")
    need = spark.createDataFrame([("t", p, t) for p in (2, 4, 5, 6, 7) for t in (1, 4, 5, 6, 7)],
                                 "vocab_lang string, prev_id int, token_id int")
    counts, contexts = TM.transferred_counts(weights, lm, need)
    n = {(r.method, r.prev_id): r.n for r in contexts.collect()}
    c = {(r.method, r.prev_id, r.token_id): r.c for r in counts.collect()}
    assert n[("omp", 5)] == 2 * 11 - 0.5 * 1 and n[("fvt", 5)] == 0.5 * 0 + 0.5 * 1
    assert c[("omp", 2, 5)] == 6.0                 # 2 * 6 - 0 is more than the context has
    assert c[("omp", 4, 5)] == 0.0                 # -0.5 * 8
    assert c[("omp", 5, 7)] == 2 * 8 - 0.5 * 1     # ab b twice, b b half as often, taken away
    assert c[("fvt", 4, 5)] == 0.5 * 8 and c[("fvt", 4, 1)] == 3.0


def test_plan(spark):
    plan = TM.model_plan(spark.createDataFrame([("s",), ("t",)], "lang string")).collect()
    got = {(r.regime, r.src_lang, r.label): (r.model, list(r.parts)) for r in plan}
    assert len(plan) == 2 * 3 * 4
    assert got[("no-finetuning", "s", "fvt")] == ("t|fvt:s", ["fvt:s"])
    assert got[("mono-finetuning", "s", "omp")][1] == ["omp:s", "t"]
    assert got[("mixed-finetuning", "s", "100mb_src")] == ("s|s+s+t", ["s", "s", "t"])
    assert {got[(r, "s", "10mb_tgt")][0] for r in ("no-finetuning", "mono-finetuning", "mixed-finetuning")} == {"t|t"}


def test_lines_against_plain_loops(spark):
    vocab = spark.createDataFrame([("s", "a", 4), ("s", "b", 5)], "lang string, token string, id int")
    texts = ["a b a a c", "c c c c", "a", "b a", "a b b a"]
    lines = spark.createDataFrame([("s", 1, i, x) for i, x in enumerate(texts)], "lang string, doc_id long, line_no int, line string")
    labels = TM.label_counts(lines, vocab, 5)
    seen, _ = TM.heavy_bigrams(labels)
    losses = (seen.drop("lines").withColumn("model", F.lit("m")).withColumn("V", F.lit(6.0))
              .withColumn("q", TM.whole(F.log(F.lit(2.0) + F.col("token_id") + 3 * F.col("prev_id")))))
    for heavy in (seen.drop("lines").limit(0), seen.drop("lines").limit(2), seen.drop("lines")):
        got = {r.line_no: r for r in TM.score_lines(labels, losses, heavy, 5).collect()}
        for i, text in enumerate(texts):
            ids = [{"a": 4, "b": 5}.get(w, 1) for w in text.split(" ")]
            loss = lambda x: [math.log(2 + t + 3 * p) for p, t in zip([2, *x], x, strict=False)]
            h = len(text[:len(text) // 2].split(" ")) if text[:len(text) // 2] else 0
            bits = sum(0 if k < h else math.log2(6) if t == 1 else v / math.log(2)
                       for k, (t, v) in enumerate(zip(ids, loss(ids), strict=True)) if k < 4)
            assert got[i].surprisal == pytest.approx(bits) and got[i].n_read == min(len(ids), 4)
            assert got[i].n_unk == sum(t == 1 for t in ids[:4]) and got[i].over == (len(ids) >= 5)
            assert got[i].delta / TM.UNIT == pytest.approx(sum(loss(ids[::-1])) - sum(loss(ids)), abs=1e-9)
        assert got[1].delta == 0 and got[4].delta == 0  # the same words again: an exact tie


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_blocks_of_packed_lines_under_many_models(spark, size):
    vocab = spark.createDataFrame([("s", "a", 4), ("s", "b", 5), ("t", "b", 4)], "lang string, token string, id int")
    texts = ["a b a a c", "c c c c", "a", "b a", "a b b a", "b a", "a b b"]
    rows = [(x, None if i == 5 else i % 3, i, text) for i, text in enumerate(texts) for x in ("s", "t")]
    lines = spark.createDataFrame([*rows, ("s", 0, 6, "a a")], "lang string, doc_id long, line_no int, line string")
    packed = TM.packed_lines(TM.label_counts(lines, vocab, 5)).cache()
    flat = TM.unpacked_lines(packed)
    assert packed.count() == 2 * len({r[:3] for r in rows} | {("s", 0, 6)}) + 2  # a line read twice, of another length
    seen, heavy = TM.heavy_bigrams(flat)
    models = F.when(F.col("vocab_lang") == "s", F.array(F.lit("m"), F.lit("n"))).otherwise(F.array(F.lit("o")))
    losses = (seen.drop("lines").withColumn("models", models).withColumn("V", F.lit(6.0)).withColumn("q", F.transform(
        "models", lambda m: TM.whole(F.log(2.0 + F.col("token_id") + F.ascii(m) * F.col("prev_id"))))))
    one = losses.select("vocab_lang", "lang", "prev_id", "token_id", "V", F.explode(F.arrays_zip(F.col("models").alias("m"), "q")).alias("z"))
    want = (flat.join(one, ["vocab_lang", "lang", "prev_id", "token_id"]).groupBy(*TM.LINE, "z.m")
            .agg(F.sum(F.when(F.col("token_id") == 1, 0).otherwise(F.col("n_scored") * F.col("z.q"))).alias("known"),
                 F.sum(F.when(F.col("token_id") == 1, F.col("n_scored")).otherwise(0)).alias("unknown"),
                 F.sum((F.col("n_wrong") - F.col("n_sen")) * F.col("z.q")).alias("delta")).collect())
    got = TM.score_lines(packed, losses, heavy, 5, block_labels=size).collect()
    shown = lambda r, bits: (r.lang, r.doc_id, r.line_no, r.nbytes, r.delta, round(bits, 9))
    assert sorted(((r.model, *map(str, shown(r, r.surprisal))) for r in got)) == sorted(
        (r.m, *map(str, shown(r, r.known / TM.UNIT / math.log(2) + r.unknown * math.log2(6)))) for r in want)


def _scored_models(spark):
    """Lines with a repeated key, a repeated line, an unknown language and double spaces, and two vocabularies."""
    vocab = spark.createDataFrame([("s", "a", 4), ("s", "b", 5), ("t", "b", 4), ("t", "", 5)], "lang string, token string, id int")
    rows = [("s", 1, 0, "a b a a c"), ("s", 1, 0, "b a b c b"), ("s", 1, 0, "a b a a c"), ("t", None, 1, "b  b q b b"),
            (None, 2, 0, "a b"), ("t", 3, 0, "c c c"), ("t", 3, 1, "b"), ("t", 3, 2, "")]
    return vocab, spark.createDataFrame(rows, "lang string, doc_id long, line_no int, line string")


def test_counted_lines_equal_joined_ones_without_joins(spark):
    vocab, lines = _scored_models(spark)
    got = TM.counted_lines(lines, vocab, 4, known_entries=4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # a line is split once for all vocabularies
    want = TM._joined_label_counts(lines, vocab, 4, None, None)
    shown = lambda df: sorted(map(str, df.select(*TM.LINE, *TM.COUNTED).collect()))
    assert shown(TM.unpacked_lines(got)) == shown(want) != []
    assert shown(TM.label_counts(lines, vocab, 4, known_entries=10**9)) == shown(want)


def test_text_counts_split_the_corpus_once(spark):
    from transvoc.operators.tokenize import encode_long
    vocab, lines = _scored_models(spark)
    rows = encode_long(lines, vocab, "all", keys=["lang"])
    want = rows.groupBy("vocab_lang", "lang", F.col("prev_id").alias("prev"), F.col("token_id").alias("tok")).agg(
        F.count(F.lit(1)).alias("n"))
    for known in (None, 4):
        got = TM.text_counts(lines, vocab, known)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Generate")  # the vocabularies are met above the split, by counted pairs
    assert plan.count("Generate") == 1


def test_losses_follow_the_parts_in_order(spark):
    plan = TM.model_plan(spark.createDataFrame([("s",), ("t",)], "lang string"))
    seen = spark.createDataFrame([("t", "s", 4, 5), ("t", "t", 4, 5), ("t", "t", 1, 1), ("t", None, 4, 5)],
                                 "vocab_lang string, lang string, prev_id int, token_id int")
    counts = {"t": 2.0, "s": 1.0, "fvt:s": 0.3}
    contexts = {"t": 7.0, "s": 3.0, "omp:s": 0.9}
    c = spark.createDataFrame([("t", k, 4, 5, v) for k, v in counts.items()],
                              "vocab_lang string, part string, prev_id int, token_id int, c double")
    n = spark.createDataFrame([("t", k, 4, v) for k, v in contexts.items()],
                              "vocab_lang string, part string, prev_id int, n double")
    sizes = spark.createDataFrame([("s", 6.0), ("t", 6.0)], "vocab_lang string, V double")
    out = TM.model_losses(seen, plan, c, n, sizes, 0.1)
    parts = {r.model: list(r.parts) for r in plan.collect()}
    got = out.collect()
    assert sorted((r.lang, r.prev_id) for r in got) == [("s", 4), ("t", 1), ("t", 4)]  # a null language has no model
    for r in got:
        assert list(r.models) == sorted(r.models) and len(r.q) == len(r.models) and r.V == 6.0
        for model, q in zip(r.models, r.q, strict=True):
            top = sum(counts.get(p, 0.0) for p in parts[model]) if r.prev_id == 4 else 0.0
            below = sum(contexts.get(p, 0.0) for p in parts[model]) if r.prev_id == 4 else 0.0
            assert abs(q - round(-math.log((top + 0.1) / (below + 0.6)) * TM.UNIT)) <= 1
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString()  # losses of a batch are computed together


def test_pairs_of_words_are_counted_before_they_leave_a_task(spark):
    """No row a word: batches of lines give counted pairs, and the labels are opened once for the losses of a block."""
    vocab, lines = _scored_models(spark)
    plan = TM.text_counts(lines, vocab, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "prev_token" not in plan
    labels = TM.counted_lines(lines, vocab, 4, known_entries=4)
    seen = TM.seen_bigrams(TM.unpacked_lines(labels))
    losses = (seen.drop("lines").withColumn("models", F.array(F.lit("m"))).withColumn("V", F.lit(6.0))
              .withColumn("q", F.array(F.lit(1).cast("long"))))
    scored = TM.score_lines(labels.localCheckpoint(), losses.localCheckpoint(), seen.drop("lines").limit(1).localCheckpoint(), 4)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(arrays_zip(prev_id") == 1 and "aggregate(" not in plan


@pytest.mark.parametrize("most", [1, 3, 10**6])
def test_word_portions_hold_all_words(most):
    import pyarrow as pa

    from transvoc.operators.vocab import word_portions
    texts = [["a b", None, "", "c  d"], [], [""], [" e"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(["s"] * len(t), pa.string()), pa.array(t, pa.string())], ["lang", "line"])
               for t in texts]
    got = list(word_portions(iter(batches), most=most))
    assert [w for _, _, words in got for w in words.to_pylist()] == ["a", "b", "c", "", "d", "", "e"]
    assert [n for langs, sizes, _ in got for n in zip(langs.to_pylist(), sizes.tolist(), strict=True)] == [("s", 2), ("s", 3), ("s", 2)]


def test_counts_of_parts_are_shuffled_once(spark):
    import re
    plan = TM.model_plan(spark.createDataFrame([("s",), ("t",)], "lang string"))
    seen = spark.createDataFrame([("t", "s", 4, 5)], "vocab_lang string, lang string, prev_id int, token_id int")
    c = spark.createDataFrame([("t", "s", 4, 5, 1.0), ("t", "t", 4, 5, 2.0)],
                              "vocab_lang string, part string, prev_id int, token_id int, c double")
    n = spark.createDataFrame([("t", "s", 4, 3.0)], "vocab_lang string, part string, prev_id int, n double")
    sizes = spark.createDataFrame([("s", 6.0), ("t", 6.0)], "vocab_lang string, V double")
    steps = TM.model_losses(seen, plan, c, n, sizes, 0.1)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", steps)
    assert sum("token_id" in by for by in dealt) <= 2  # the counts and the bigrams seen, dealt alike
    assert not any("token_id" in by and "part#" in by for by in dealt)


def test_bigrams_of_packed_lines_are_counted_in_batches(spark, monkeypatch):
    vocab, lines = _scored_models(spark)
    packed = TM.counted_lines(lines, vocab, 4, known_entries=4)
    want = TM.seen_bigrams(TM.unpacked_lines(packed))
    got = TM.seen_bigrams(packed)
    assert got.schema.names == want.schema.names
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for a bigram of a line
    none = TM.seen_bigrams(TM.counted_lines(lines.limit(0), vocab, 4, known_entries=4))
    assert none.collect() == []


@pytest.mark.parametrize("most", [1, 3, 10**6])
def test_losses_of_a_line_are_summed_across_portions(monkeypatch, most):
    import pyarrow as pa
    monkeypatch.setattr(TM, "SUMMED_LABELS", most)
    big = 2**55
    ints = lambda rows, kind=pa.int32(): pa.array(rows, pa.list_(kind))
    ids = [[4, 5, 6], [], [9], [5], [4, 1]]  # no loss is known for 9
    n = lambda x: ints([[x] * len(r) for r in ids])
    lines = pa.table({"k": pa.array([len(r) for r in ids]), "prev_id": n(2), "token_id": ints(ids),
                      "n_scored": n(3), "n_wrong": ints([[0, 2, 1], [], [0], [1], [0, 4]]), "n_sen": n(1)})
    q = {1: [10, 20], 4: [big, -1], 5: [1, 2], 6: [7, big]}
    losses = pa.table({"prev_id": pa.array([2] * 4, pa.int32()), "token_id": pa.array([6, 1, 5, 4], pa.int32()),
                       "q": ints([q[6], q[1], q[5], q[4]], pa.int64())})
    known, delta, scored = TM._score_block(lines, losses)
    assert known.tolist() == [[3 * (big + 8), 3 * (big + 1)], [0, 0], [0, 0], [3, 6], [3 * big, -3]]
    assert delta.tolist() == [[-big + 1, 1 + 2], [0, 0], [0, 0], [0, 0], [-big + 30, 1 + 60]]
    assert scored.tolist() == [True, False, False, True, True]
