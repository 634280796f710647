"""OMP against exact cases and a NumPy reference; FVT rules."""

import numpy as np
import pytest

from transvoc.operators import transfer
from transvoc.operators.transfer import fvt_transfer, omp


def anchors_frame(spark, D, B, names):
    rows = [("s", "t", n, i, [float(x) for x in D[i]], [float(x) for x in B[i]]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "src_lang string, tgt_lang string, token string, tgt_id int, "
                                       "donor array<float>, base array<float>")


def missing_frame(spark, rows, src="s"):
    return spark.createDataFrame([(src, "t", *r) for r in rows],
                                 "src_lang string, tgt_lang string, token string, tgt_id int, donor array<float>")


def test_omp_exact_reconstruction(spark):
    D = np.eye(4)[:3]                       # orthonormal anchors a1, a2, a3
    B = np.arange(12, dtype=float).reshape(3, 4)
    y = 2 * D[0] + 3 * D[1]
    missing = missing_frame(spark, [("m", 100, [float(x) for x in y])])
    r = omp(missing, anchors_frame(spark, D, B, ["a1", "a2", "a3"]), k=2).first()
    assert list(r["support"]) == ["a2", "a1"]
    assert r["coefs"] == pytest.approx([3.0, 2.0])
    assert r["residual"] == pytest.approx(0.0, abs=1e-9)
    assert r["vec"] == pytest.approx(list(3 * B[1] + 2 * B[0]))


def plain_omp(y, D, k, tol=1e-10):
    """Matching pursuit by definition: a least-squares fit on all chosen anchors a step."""
    norms, chosen, c, r = np.linalg.norm(D, axis=1), [], np.zeros(0), y.copy()
    while len(chosen) < k and np.linalg.norm(r) > tol * max(1.0, np.linalg.norm(y)):
        score = np.round(np.abs(D @ r) / norms, 12)
        if score.max() <= tol:
            break
        chosen.append(int(np.argmax(score)))
        c, *_ = np.linalg.lstsq(D[chosen].T, y, rcond=None)
        r = y - D[chosen].T @ c
    return chosen, c, r


@pytest.mark.parametrize("shard", [3, 7, 1000])
@pytest.mark.parametrize(("anchors", "dims", "k"), [(40, 16, 1), (40, 16, 8), (40, 16, 64), (10, 16, 64), (90, 64, 64)])
def test_batch_equals_least_squares(monkeypatch, anchors, dims, k, shard):
    monkeypatch.setattr(transfer, "SHARD_ANCHORS", shard)
    rng = np.random.default_rng(anchors + k)
    D, Y = rng.normal(size=(anchors, dims)), rng.normal(size=(25, dims))
    Y[3], Y[4], Y[5] = 2 * D[2], D[1] - 3 * D[7], 0.0
    state, support = transfer._solve_batch(Y, D, D / np.linalg.norm(D, axis=1)[:, None], k, 1e-10)
    for y, s, c, r in zip(Y, support, state.coefficients(), state.rest, strict=True):
        want = plain_omp(y, D, k)
        assert s == want[0] and len(set(s)) == len(s)
        assert np.allclose(c, want[1], atol=1e-7) and np.allclose(r, want[2], atol=1e-8)
    assert support[3] == [2] and support[5] == []


def test_dependent_anchors_end_the_pursuit():
    D = np.array([[1.0, 0, 0], [0, 1.0, 0], [1.0, 1.0, 0]])
    Y = np.array([[3.0, 1.0, 5.0]])
    state, support = transfer._solve_batch(Y, D, D / np.linalg.norm(D, axis=1)[:, None], 3, 1e-10)
    assert len(support[0]) == 2 and np.allclose(np.abs(state.rest[0]), [0, 0, 5])


def test_omp_ties_pick_lowest_id(spark):
    D = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    B = np.eye(3, 2)
    missing = missing_frame(spark, [("m", 9, [1.0, 0.0])])
    r = omp(missing, anchors_frame(spark, D, B, ["x", "y", "z"]), k=1).first()
    assert list(r["support"]) == ["x"]


def test_fvt_copy_mean_unknown(spark):
    vocab = spark.createDataFrame([("s", "ab", 4), ("s", "a", 5), ("s", "b", 6),
                                   ("t", "ab", 4), ("t", "ba", 5), ("t", "q", 6)], "lang string, token string, id int")
    emb = spark.createDataFrame([(1, [9.0, 9.0]), (4, [1.0, 1.0]), (5, [2.0, 0.0]), (6, [0.0, 4.0])],
                                "id int, vec array<float>")
    res = fvt_transfer(vocab, vocab, emb).where("src_lang = 's'").collect()
    got = {(r["token"], r["dim"]): (r["kind"], r["value"]) for r in res}
    assert got[("ab", 0)] == ("copy", 1.0)          # shared: copied
    assert got[("ba", 0)] == ("mean", 1.0) and got[("ba", 1)] == ("mean", 2.0)   # mean of b, a
    assert got[("q", 0)] == ("mean", 9.0)           # unknown piece -> unknown vector
    with pytest.raises(Exception, match="no source vector"):
        fvt_transfer(vocab, vocab, emb.where("id <> 1")).collect()


def test_omp_without_anchors(spark):
    anchors = anchors_frame(spark, np.eye(2), np.eye(2), ["x", "y"])
    missing = missing_frame(spark, [("m", 9, [3.0, 4.0])], src="other")
    r = omp(missing, anchors, 3).first()
    assert (list(r["support"]), list(r["coefs"]), r["residual"], list(r["vec"])) == ([], [], 5.0, [])


def test_omp_independent_of_batches(spark):
    rng = np.random.default_rng(4)
    D = rng.normal(size=(30, 6)).astype(np.float32)
    D[[3, 17]] = D[5]                       # exact ties
    anchors = anchors_frame(spark, D, rng.normal(size=(30, 5)), [f"a{i}" for i in range(30)])
    Y = rng.normal(size=(12, 6))
    Y[0] = D[5]
    missing = missing_frame(spark, [(f"m{i}", 1000 + i, [float(x) for x in Y[i]]) for i in range(12)])
    one = {r["token"]: r for r in omp(missing, anchors, 3).collect()}
    two = {r["token"]: r for r in omp(missing, anchors, 3, batch_tokens=2).collect()}
    assert one == two and list(one["m0"]["support"]) == ["a3"]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("k", [8, 64])
def test_omp_queries_against_numpy(spark, k):
    """The registered queries vs a plain NumPy OMP over the same inputs, two pairs of languages."""
    from transvoc import testbed as tb
    from transvoc.queries import transfer as Q
    d = "/root/testdata/sf0.001"
    tb.reset_scope()
    anchors, missing = tb.transfer_inputs(spark, d)
    A, M = anchors.toPandas(), missing.toPandas()
    tb.reset_scope()
    got = {(r["src_lang"], r["tgt_lang"], r["token"]): r
           for r in {8: Q.omp_k8, 64: Q.omp_k64}[k](spark, d).collect()}
    assert len(got) == len(M)
    for pair in (("en", "fr"), ("de", "en")):
        own = A[(A.src_lang == pair[0]) & (A.tgt_lang == pair[1])].sort_values("tgt_id")
        D = np.stack(own["donor"].to_numpy()).astype(float)
        Bm = np.stack(own["base"].to_numpy()).astype(float)
        rows = M[(M.src_lang == pair[0]) & (M.tgt_lang == pair[1])].head(150)
        _, distinct = np.unique(D, axis=0, return_index=True)
        D, Bm = D[np.sort(distinct)], Bm[np.sort(distinct)]
        for tok, y in zip(rows["token"], rows["donor"], strict=True):
            chosen, c, r = plain_omp(np.asarray(y, dtype=float), D, k)
            row = got[(*pair, tok)]
            assert row["n_support"] == len(chosen)
            assert row["residual"] == pytest.approx(float(np.linalg.norm(r)), abs=1e-6)
            assert row["new_sum"] == pytest.approx(float((Bm[chosen].T @ c).sum()), abs=1e-5)
