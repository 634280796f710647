"""Sampled sparse matrix products ``W C W'``, many at once, in blocks.

``W`` has a row for each token of a group (a model) and ``C`` is the group's square
matrix of counts; the product is wanted at some positions only.  The wanted
rows are dealt into blocks and the inner columns into shards, both by their
counts; a task holds the entries of one block and one shard, multiplies them, and sends
one partial sum for each position.  The shards' sums are added by Spark.  So no
task's memory follows the size of ``W`` or ``C``, whatever row or column is heavy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in a block, and entries of C in a shard, about.
BLOCK_ROWS, SHARD_ENTRIES = 1024, 1_000_000
#: Terms that are multiplied at a time.
CHUNK = 2_000_000


def _spans(counts: np.ndarray, most: int):
    """Consecutive ranges of items with at most ``most`` terms each (one item at least)."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i] ... starts[i] + counts[i] - 1`` of all items, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def _by_key(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and where each key's entries begin and how many there are."""
    counts = np.bincount(keys, minlength=size)
    return np.argsort(keys, kind="stable"), np.cumsum(counts) - counts, counts


def multiply(left: tuple, c: tuple, right: tuple, wanted: tuple) -> np.ndarray:
    """``sum over a, b of left[p, a] c[a, b] right[t, b]`` for each wanted ``(p, t)``; matrices are
    ``(row, column, value)``."""
    (lr, lc, lv), (ca, cb, cv), (rr, rc, rv), (p, t) = left, c, right, wanted
    mids, of = np.unique(np.concatenate((lc, ca)), return_inverse=True)
    lc, ca = np.split(of, [len(lc)])
    inner, of = np.unique(np.concatenate((cb, rc)), return_inverse=True)
    cb, rc = np.split(of, [len(cb)])
    rows, of = np.unique(np.concatenate((p, lr)), return_inverse=True)
    p, lr = np.split(of, [len(p)])
    others, of = np.unique(np.concatenate((t, rr)), return_inverse=True)
    t, rr = np.split(of, [len(t)])
    order, start, size = _by_key(ca, len(mids))
    cb, cv, wide = cb[order], cv[order], len(inner)
    dense = np.zeros(len(rows) * wide)  # left times c, block by shard
    for a, b in _spans(size[lc], CHUNK):
        n = size[lc[a:b]]
        at = _expand(start[lc[a:b]], n)
        dense += np.bincount(np.repeat(lr[a:b] * wide, n) + cb[at], weights=np.repeat(lv[a:b], n) * cv[at],
                             minlength=len(dense))
    order, start, size = _by_key(rr, len(others))
    rc, rv = rc[order], rv[order]
    out = np.zeros(len(p))
    for a, b in _spans(size[t], CHUNK):
        n = size[t[a:b]]
        at = _expand(start[t[a:b]], n)
        out[a:b] = np.bincount(np.repeat(np.arange(b - a), n), minlength=b - a,
                               weights=dense[np.repeat(p[a:b] * wide, n) + rc[at]] * rv[at])
    return out


def sampled_product(weights: DataFrame, counts: DataFrame, wanted: DataFrame, groups: Sequence[str],
                    block_rows: int = BLOCK_ROWS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``(groups.., p, t, c)`` for every wanted position whose product is not 0.

    ``weights``: ``(groups.., row, col, w)``; ``counts``: ``(groups.., a, b, n)``; ``wanted``: ``(groups.., p, t)``;
    rows and columns are whole numbers.
    """
    groups = list(groups)
    lit = F.lit(0).cast("long")
    sizes = (counts.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_entries)).alias("shards"))
             .join(wanted.groupBy(*groups).agg(F.ceil(F.count_distinct("p") / F.lit(block_rows)).alias("blocks")), groups))
    keys = [*groups, "block", "shard"]
    every = lambda c, n: F.explode(F.sequence(lit, F.col(n) - 1)).alias(c)
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).alias("block")
    shard = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.col("shards")).alias("shard")
    number = lambda *cs: [F.col(c).cast("long").alias(x) for c, x in zip(cs, ("i", "j"), strict=True)]
    sized = lambda df: df.join(F.broadcast(sizes), groups)  # noqa: E731  one row a group
    w, c = sized(weights), sized(counts)
    # W once for its rows in the block (all columns) and once for its columns in the shard (all rows)
    first = w.join(wanted.select(*groups, F.col("p").alias("row")).distinct(), [*groups, "row"], "left_semi").select(
        *groups, block("row"), F.lit("p").alias("kind"), *number("row", "col"), "w", "shards").select(
        *groups, "block", every("shard", "shards"), "kind", "i", "j", F.col("w").alias("x"))
    second = w.select(*groups, shard("col"), F.lit("t").alias("kind"), *number("row", "col"), "w", "blocks").select(
        *groups, every("block", "blocks"), "shard", "kind", "i", "j", F.col("w").alias("x"))
    inner = c.select(*groups, shard("b"), F.lit("c").alias("kind"), *number("a", "b"), "n", "blocks").select(
        *groups, every("block", "blocks"), "shard", "kind", "i", "j", F.col("n").cast("double").alias("x"))
    entries = first.unionByName(second).unionByName(inner)
    places = sized(wanted).select(*groups, block("p"), *number("p", "t"), "shards").select(
        *groups, "block", every("shard", "shards"), "i", "j")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*groups).schema)

    def run(own: pa.Table, right: pa.Table) -> pa.Table:
        of = {k: right.filter(pc.equal(right.column("kind"), k)) for k in "ptc"}
        arrays = {k: tuple(x.column(n).to_numpy() for n in ("i", "j", "x")) for k, x in of.items()}
        p, t = own.column("i").to_numpy(), own.column("j").to_numpy()
        c = multiply(arrays["p"], arrays["c"], arrays["t"], (p, t))
        keep = np.flatnonzero(c)
        out = {g: own.column(g).take(pa.array(keep)) for g in groups}
        return pa.table(out | {"p": pa.array(p[keep]), "t": pa.array(t[keep]), "c": pa.array(c[keep])})

    return (places.groupBy(*keys).cogroup(entries.toDF(*(f"r_{n}" for n in entries.columns))
                                          .toDF(*entries.columns).groupBy(*keys))
            .applyInArrow(run, f"{kinds}, p long, t long, c double")
            .repartition(*groups, "p")  # rows of the product stay together for the caller
            .groupBy(*groups, "p", "t").agg(F.sum("c").alias("c")))

