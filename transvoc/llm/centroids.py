"""Centroid clustering of integer vectors by bit planes and popcounts.

A component ``x`` becomes the integer ``floor(scale * x)``.  A vector of 64
integers is kept as bit planes: plane ``i`` is one 64-bit word that holds bit
``i`` of every component (two's complement, so the top plane weighs
``-2**(planes - 1)``).  The dot product of a vector and a centroid is the sum
over plane pairs of ``weight_i * weight_j * popcount(plane_i & plane_j)``, which
is exact, and so is the squared distance ``|a|^2 - 2ab + |b|^2``.

The planes are written once below ``spark.checkpoint.dir``; every round reads
only them.  A round's tasks assign their vectors and send one row of counts and
component sums for each centroid; the rows are added up by Spark, and ``k`` rows
reach the driver.  The driver holds ``k`` centroids of 64 numbers, whatever the
number of vectors, and no task gathers a cluster: one that holds most of the
vectors costs its tasks no more than any other.

Defined results: a vector that is null, has another number of components than
64, or has a null or non-finite one is left out.  The first centroids are the
vectors with the smallest sha256 of ``<seed>:<key>``, ties by planes; a null
key comes last.  Fewer vectors than ``k`` give as many centroids.  Equal distances
go to the smaller number, so repeated vectors share a cluster; repeated rows each
give a row.  A centroid without vectors stays.  An integer of ``MOST`` or more in
size ends the job with an error, as its squared distances need not fit in 64 bits.  An
empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transvoc.session import cut_lineage

#: Components of a vector: the bits of one plane.
DIMS = 64
#: Size that the integers stay below: 64 squared differences then fit in 64 bits.
MOST = 1 << 27
#: Vectors that are compared with the centroids at a time.
CHUNK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector has 64 components, all of them numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == DIMS) & finite, F.lit(False))


def plane_count(numbers: np.ndarray) -> int:
    """Planes that hold all of ``numbers`` in two's complement."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    return max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1


def to_planes(numbers: np.ndarray) -> np.ndarray:
    """``(n, 64)`` integers as ``(n, planes)`` words."""
    shifts = np.arange(plane_count(numbers), dtype=np.int64)
    bits = (numbers[:, None, :] >> shifts[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts: powers of two, the top one negative."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def from_planes(planes: np.ndarray) -> np.ndarray:
    """``(n, planes)`` words as ``(n, 64)`` integers."""
    packed = np.ascontiguousarray(planes.astype("<u8"))[:, :, None].view(np.uint8)
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    return np.einsum("npd,p->nd", bits, weights(planes.shape[1]))


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all vectors ``a`` with all vectors ``b``, both as planes."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i, of_a in enumerate(weights(a.shape[1])):
        for j, of_b in enumerate(weights(b.shape[1])):
            out += of_a * of_b * np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64)
    return out


def squared_norms(a: np.ndarray) -> np.ndarray:
    """Dot product of each vector with itself."""
    out = np.zeros(len(a), np.int64)
    w = weights(a.shape[1])
    for i in range(len(w)):
        for j in range(len(w)):
            out += w[i] * w[j] * np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64)
    return out


def nearest(a: np.ndarray, norms: np.ndarray, centroids: np.ndarray,
            centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller), and the squared distance."""
    apart = norms[:, None] - 2 * dot_products(a, centroids) + centroid_norms[None, :]
    best = np.argmin(apart, axis=1)
    return best, apart[np.arange(len(a)), best]


def pack(vectors: DataFrame, vector: str, scale: float, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of the usable vectors as struct ``row``, with ``planes`` and ``norm``."""
    frame = (vectors.where(usable(F.col(vector)))
             .select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
                     F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            scaled = np.floor(scale * x)
            if np.abs(scaled).max() >= MOST:
                raise ValueError(f"a component times {scale} is {MOST} or more in size")
            planes = to_planes(scaled.astype(np.int64))
            width = planes.shape[1]
            offsets = pa.array(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(planes.view(np.int64).ravel())),
                 pa.array(squared_norms(planes))], names=["row", "planes", "norm"])

    fields = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(run, f"row {fields}, planes array<long>, norm long")


def _chunks(batches: Iterator[pa.RecordBatch], planes: int, norm: int) -> Iterator[tuple]:
    """Batch, where the chunk begins, planes and norms; a chunk's vectors have as many planes as one another."""
    for batch in batches:
        lists = batch.column(planes)
        words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        widths = np.diff(ends, prepend=0)
        norms = batch.column(norm).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(widths)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(widths)], strict=True):
            for at in range(start, stop, CHUNK):
                to = min(at + CHUNK, stop)
                first = int(ends[at] - widths[at])
                yield batch, at, words[first:int(ends[to - 1])].reshape(to - at, -1), norms[at:to]


def _centroid_planes(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    planes = to_planes(centroids)
    return planes, squared_norms(planes)


def assign(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``row, cluster, distance`` of every packed vector."""
    planes, norms = _centroid_planes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, words, own in _chunks(batches, 1, 2):
            best, apart = nearest(words, own, planes, norms)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(words)), pa.array(best.astype(np.int32)), pa.array(apart)],
                names=["row", "cluster", "distance"])

    fields = packed.schema["row"].dataType.simpleString()
    return packed.select("row", "planes", "norm").mapInArrow(run, f"row {fields}, cluster int, distance long")


def cluster_sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, sums``: vectors and component sums, one row for each cluster that has any."""
    planes, norms = _centroid_planes(centroids)
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for _, _, words, own in _chunks(batches, 0, 1):
            best, _ = nearest(words, own, planes, norms)
            numbers = from_planes(words)
            for c in np.unique(best):
                mine = best == c
                count[c] += int(mine.sum())
                sums[c] += numbers[mine].sum(axis=0)
        seen = np.flatnonzero(count)
        offsets = pa.array(np.arange(0, (len(seen) + 1) * DIMS, DIMS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(count[seen]),
             pa.ListArray.from_arrays(offsets, pa.array(sums[seen].ravel()))], names=["cluster", "n", "sums"])

    parts = packed.select("planes", "norm").mapInArrow(run, "cluster int, n long, sums array<long>")
    return (parts.groupBy("cluster")
            .agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(DIMS)))
            .select("cluster", "n", F.array(*(f"s{d}" for d in range(DIMS))).alias("sums")))


def first_centroids(packed: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"row.`{key}`").cast("string")), 256)
    rows = (packed.select(digest.alias("digest"), "planes")
            .orderBy(F.col("digest").asc_nulls_last(), "planes").limit(k).collect())
    numbers = [from_planes(np.array([r["planes"]], np.int64).view(np.uint64))[0] for r in rows]
    return np.array(numbers, np.int64).reshape(-1, DIMS)


def cluster(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", k: int = 16,
            rounds: int = 3, scale: float = 64, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and the ``keep`` columns of every usable vector with ``cluster, distance``, the sums of distances
    ``cluster_inertia, inertia``, and the final ``centroid``, after ``rounds`` of assigning and averaging."""
    spark = vectors.sparkSession
    kept = (key, *(c for c in keep if c != key))
    packed = cut_lineage(pack(vectors, vector, scale, kept), "centroid-planes")
    centroids = first_centroids(packed, key, k, seed)
    if not len(centroids):
        return packed.select(
            *(F.col(f"row.`{c}`").alias(c) for c in kept), F.lit(0).alias("cluster"),
            *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")),
            F.array().cast("array<long>").alias("centroid"))
    for _ in range(rounds):
        for r in cluster_sums(packed, centroids).collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    assigned = cut_lineage(assign(packed, centroids), "centroid-clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise ValueError("the distances add up to more than 64 bits hold")
    table = spark.createDataFrame(
        [(c, inertia.get(c, 0), total, row.tolist()) for c, row in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return (assigned.join(F.broadcast(table), "cluster")
            .select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "cluster", "distance",
                    "cluster_inertia", "inertia", "centroid"))
