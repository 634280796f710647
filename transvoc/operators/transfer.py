"""Embedding transfer between vocabularies (JOB-4 averaging, JOB-5 sparse
reconstruction), for any number of (source, target) pairs at once.

Embedding tables are long: ``(token, id, vec array<float>)`` per space.

* FVT (averaging) is pure DataFrame work: shared tokens copy their source
  vector; every other target token is split into source pieces (greedy
  longest match), the pieces' source vectors are joined and averaged per
  dimension.
* OMP (orthogonal matching pursuit): missing tokens are dealt into batches whose
  number follows their count; each batch meets the anchors of its pair (shared
  tokens, at most one vocabulary) in a cogroup and all its tokens take their
  steps together: one matrix product with a shard of anchors after the other and
  one arg-max over the shards, then one new column of every token's factor.
  Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transvoc.operators.trie import greedy_pieces

SCORE_DIGITS = 12  # selection scores are compared after rounding (ties -> lowest id)
#: Missing tokens that share one copy of their pair's anchors (their basis takes batch x k x dimensions numbers).
BATCH_TOKENS = 512
#: Anchors that a batch is compared with at a time.
SHARD_ANCHORS = 8192


def pair_tokens(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-8 / JN-9 for every ordered pair of languages of ``vocab``: the shared
    tokens (``src_lang, tgt_lang, token, tgt_id, src_id``) and the target tokens
    that the source lacks (without ``src_id``)."""
    tgt = vocab.select(F.col("lang").alias("tgt_lang"), "token", F.col("id").alias("tgt_id"))
    src = vocab.select(F.col("lang").alias("src_lang"), "token", F.col("id").alias("src_id"))
    shared = tgt.join(src, "token").where("src_lang <> tgt_lang")
    # one row per vocabulary: each target token once per other language
    langs = vocab.select(F.col("lang").alias("src_lang")).distinct()
    missing = (tgt.join(F.broadcast(langs), F.col("src_lang") != F.col("tgt_lang"))
               .join(src.select("src_lang", "token"), ["src_lang", "token"], "left_anti"))
    return shared, missing


def fvt_transfer(vocab: DataFrame, pieces: DataFrame, src_emb: DataFrame) -> DataFrame:
    """JOB-4: ``(src_lang, tgt_lang, token, tgt_id, kind, n_pieces, dim, value)`` -
    the new embedding of every target token of every ordered pair, in long form.

    ``pieces`` are the piece vocabularies, ``src_emb`` is ``(id, vec)`` over piece
    ids (the unknown id included); a piece without a vector is an error.
    ``kind`` is ``copy`` for shared tokens and ``mean`` otherwise.
    """
    keys = ["src_lang", "tgt_lang", "token", "tgt_id"]
    shared, missing = pair_tokens(vocab)
    copied = shared.select(*keys, F.array("src_id").alias("ids"), F.lit("copy").alias("kind"))
    words = missing.select(*keys, F.col("src_lang").alias("vocab_lang"), F.col("token").alias("word"))
    found = greedy_pieces(words.select("vocab_lang", "word"), pieces)
    meaned = (words.join(found, ["vocab_lang", "word"])
              .select(*keys, "ids", F.lit("mean").alias("kind")))
    allt = copied.unionByName(meaned).withColumn("n_pieces", F.size("ids"))
    per_piece = allt.select(*keys, "kind", "n_pieces", F.explode("ids").alias("id"))
    known = F.coalesce("vec", F.raise_error(F.concat(F.lit("no source vector for piece "), F.col("id"))))
    vec = (per_piece.join(src_emb.select("id", "vec"), "id", "left")
           .select(*keys, "kind", "n_pieces", F.posexplode(known).alias("dim", "x")))
    return vec.groupBy(*keys, "kind", "n_pieces", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


class Pursuit:
    """Orthogonal matching pursuit of a batch of vectors at once.

    The chosen anchors of each vector are orthonormalised one by one: ``basis``
    holds the directions, ``factor`` the triangular matrix that leads from them
    back to the anchors (the Cholesky factor of the anchors' Gram matrix, which
    grows by a column a step).  A step costs one product of the residuals with
    the anchors and one column; no least-squares problem is solved again.
    """

    def __init__(self, y: np.ndarray, k: int, tol: float):
        n, dims = y.shape
        self.tol, self.limit = tol, tol * np.maximum(1.0, np.linalg.norm(y, axis=1))
        self.rest = y.copy()
        self.basis, self.factor = np.zeros((n, k, dims)), np.zeros((n, k, k))
        self.along, self.size = np.zeros((n, k)), np.zeros(n, np.int64)
        self.open = np.linalg.norm(self.rest, axis=1) > self.limit

    def best(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of the best of the anchors ``unit`` (of length 1) for each vector, and its row; the first of equal ones."""
        score = np.round(np.abs(self.rest @ unit.T), SCORE_DIGITS)
        at = np.argmax(score, axis=1)
        return score[np.arange(len(at)), at], at

    def extend(self, score: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Adds one anchor to each vector that is still open and has a score; returns which these are."""
        self.open &= score > self.tol
        now = np.flatnonzero(self.open)
        j = int(self.size[now].max(initial=0))  # open vectors have all taken equally many
        d, basis = anchors[now], self.basis[now, :j]
        column = np.einsum("njd,nd->nj", basis, d)
        new = d - np.einsum("nj,njd->nd", column, basis)
        more = np.einsum("njd,nd->nj", basis, new)  # once more, for orthogonality to the last digit
        new -= np.einsum("nj,njd->nd", more, basis)
        length = np.linalg.norm(new, axis=1)
        new /= length[:, None]
        along = np.einsum("nd,nd->n", new, self.rest[now])
        self.rest[now] -= along[:, None] * new
        self.basis[now, j], self.along[now, j] = new, along
        self.factor[now, :j, j], self.factor[now, j, j] = column + more, length
        self.size[now] += 1
        done = now[(np.linalg.norm(self.rest[now], axis=1) <= self.limit[now]) | (self.size[now] == self.basis.shape[1])]
        self.open[done] = False
        return now

    def coefficients(self) -> list[np.ndarray]:
        """Each vector's coefficients, in the order in which the anchors were chosen."""
        out: list[np.ndarray] = [np.zeros(0)] * len(self.size)
        for m in np.unique(self.size[self.size > 0]):
            rows = np.flatnonzero(self.size == m)
            solved = np.linalg.solve(self.factor[rows, :m, :m], self.along[rows, :m, None])[:, :, 0]
            for i, c in zip(rows, solved, strict=True):
                out[i] = c
        return out


def _dictionary(frame: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, vectors, unit vectors and base vectors of a group's anchors, by id; zero vectors and later copies
    of a vector are left out, as they add nothing."""
    frame = frame.sort_values("tgt_id", kind="stable")
    if not len(frame):
        return [], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0))
    D = np.stack(frame["donor"].to_numpy()).astype(np.float64)
    norms = np.linalg.norm(D, axis=1)
    first = np.zeros(len(D), bool)
    first[np.unique(D, axis=0, return_index=True)[1]] = True
    kept = np.flatnonzero(first & (norms > 0))
    B = np.stack(frame["base"].to_numpy()[kept]).astype(np.float64) if len(kept) else np.zeros((0, 0))
    return [frame["token"].iloc[i] for i in kept], D[kept], D[kept] / norms[kept, None], B


def _solve_batch(y: np.ndarray, D: np.ndarray, unit: np.ndarray, k: int, tol: float) -> tuple[Pursuit, list[list[int]]]:
    """All steps of one batch, its anchors taken ``SHARD_ANCHORS`` at a time."""
    state, support = Pursuit(y, min(k, len(D)), tol), [[] for _ in range(len(y))]
    while state.open.any() and len(D):
        top, at = state.best(unit[:SHARD_ANCHORS])
        for start in range(SHARD_ANCHORS, len(unit), SHARD_ANCHORS):
            score, here = state.best(unit[start:start + SHARD_ANCHORS])
            better = score > top
            top[better], at[better] = score[better], here[better] + start
        for i in state.extend(top, D[at]):
            support[i].append(int(at[i]))
    return state, support


def omp(missing: DataFrame, anchors: DataFrame, k: int, groups: Sequence[str] = ("src_lang", "tgt_lang"),
        tol: float = 1e-10, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """JOB-5: each missing token from at most ``k`` anchors of its group.

    ``missing``: ``(groups..., token, tgt_id, donor array<float>)``; ``anchors``:
    ``(groups..., token, tgt_id, donor, base)``.  Output ``(groups..., token,
    tgt_id, support array<string>, coefs array<double>, residual double, vec
    array<double>)``: ``vec`` applies the coefficients to the anchors' base-space
    vectors.  Anchors are chosen until ``k``, an exact fit, or until none is left
    that is independent of the chosen ones.  A group without usable anchors gives
    empty support, the token's own length as residual and an empty ``vec``.
    """
    groups = list(groups)
    sizes = missing.groupBy(*groups).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(batch_tokens)).alias("batches"))
    left = (missing.join(sizes, groups)
            .withColumn("batch", F.pmod(F.xxhash64("token"), F.col("batches")))
            .select(*groups, "batch", "token", "tgt_id", "donor"))
    right = (anchors.join(sizes, groups)
             .withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
             .select(*groups, "batch", "token", "tgt_id", "donor", "base"))
    kinds = missing.select(*groups).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + (
        ", token string, tgt_id int, support array<string>, coefs array<double>, "
        "residual double, vec array<double>")

    def solve(tokens: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        out = tokens[[*groups, "token", "tgt_id"]].copy()
        if not len(tokens):
            return out.assign(support=[], coefs=[], residual=[], vec=[])
        names, D, unit, B = _dictionary(dictionary)
        Y = np.stack(tokens["donor"].to_numpy()).astype(np.float64)
        state, support = _solve_batch(Y, D, unit, k, tol)
        coefs = state.coefficients()
        out["support"] = [[names[i] for i in s] for s in support]
        out["coefs"] = [c.tolist() for c in coefs]
        out["residual"] = np.linalg.norm(state.rest, axis=1)
        out["vec"] = [(B[s].T @ c).tolist() if s else [0.0] * B.shape[1] for s, c in zip(support, coefs, strict=True)]
        return out

    keys = [*groups, "batch"]
    right = right.toDF(*(f"a_{c}" for c in right.columns)).toDF(*right.columns)  # columns of its own
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, schema)
