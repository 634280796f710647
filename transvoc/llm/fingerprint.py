"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its runs of five words (the whole sequence where it has
fewer words); each is hashed to 48 bits, and the fingerprint is the ``k``
smallest distinct hashes in ascending order.  Sketches merge: the ``k``
smallest hashes of the union of two fingerprints are the fingerprint of the
union of their shingle sets, so parts can be sketched apart.

Of two fingerprints, with M their merge: the resemblance is the share of M that
is in both; the number of distinct shingles is ``(k - 1) / (k-th hash as a
fraction of the range)``, exact below ``k``; containment of A in B is the
resemblance times the size of the union over the size of A.

Scale: a text is sketched where it is read, in one pass of SQL functions; what
leaves is ``k`` numbers.  :func:`with_next` brings each document its follower in
the order of ids without a global sort: ids are cut into ranges by approximate
quantiles of their distribution, one shuffle deals the rows to their range, and
only each range's first row crosses to the range before.

Defined results: null text is the empty text, whose fingerprint is empty; two
empty fingerprints resemble each other by 1, an empty and another by 0.  Equal
texts have equal fingerprints.  Of rows with the same id the smaller text comes
first; null ids come last.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.llm.words import split_words

SHINGLE_WORDS = 5
K = 100
HASH_BITS = 48
#: Rows in a range of ids, about, and the most ranges.
RANGE_ROWS = 2000
MOST_RANGES = 100_000


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hash of every shingle of ``text`` (none without words)."""
    words = F.transform(split_words(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(size))), 64 - HASH_BITS))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - HASH_BITS))
        return (F.when(n == 0, F.array().cast("array<bigint>"))
                .when(n < size, whole).otherwise(runs))

    # One-element transform: the words are hashed once and then named.
    return F.transform(F.array(words), of)[0]


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE_WORDS) -> Column:
    return bottom_k(shingle_hashes(text, size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of two shingle sets."""
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both have."""
    both = F.array_intersect(a, b)
    def of(m: Column) -> Column:
        inside = F.size(F.filter(both, lambda x: x <= F.element_at(m, -1)))
        return inside.cast("double") / F.size(m)
    merged = merge(a, b, k)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.transform(F.array(merged), of)[0])


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    span = float(1 << HASH_BITS)
    full = F.lit(float((k - 1) * span)) / (F.element_at(a, k).cast("double") + 1)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A fingerprint as a string: twelve hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), HASH_BITS // 4, "0"))), "")


def range_of(key: Column, cuts: Sequence[int]) -> Column:
    """Number of ``cuts`` at or below ``key`` (null: -1), found in two steps of
    about the square root of their number."""
    if not cuts:
        return F.when(key.isNull(), -1).otherwise(0)
    number = lambda c: F.lit(c).cast("long")
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*(number(g[0]) for g in groups))
    nested = F.array(*(F.array(*map(number, g)) for g in groups))
    group = F.size(F.filter(heads, lambda c: c <= key))
    inner = F.size(F.filter(F.element_at(nested, group), lambda c: c <= key))
    return (F.when(key.isNull(), -1).when(key < number(cuts[0]), 0)
            .otherwise((group - 1) * step + inner))


def with_next(docs: DataFrame, derive: dict[str, Column], *, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """``key, text``, the ``derive`` columns (of ``text``) and ``next``, a struct
    of text and derived columns of the row that follows in descending order of
    ``key``; the last row is followed by the first."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    wanted = min(MOST_RANGES, rows.count() // RANGE_ROWS)
    cuts: list[int] = []
    if wanted > 1:
        points = [i / wanted for i in range(1, wanted)]
        found = rows.stat.approxQuantile("key", points, 0.5 / wanted)
        cuts = sorted({min(int(c), 2**63 - 1) for c in found})
    rows = rows.withColumn("range", range_of(F.col("key"), cuts))

    # The first row of each range is also put at the end of the range before it.
    heads = rows.groupBy("range").agg(F.max("key").alias("head"))
    first = (rows.join(F.broadcast(heads.withColumnRenamed("range", "r")),
                       (F.col("range") == F.col("r")) & F.col("key").eqNullSafe(F.col("head")))
             .groupBy("range").agg(F.min("text").alias("text")))
    # One row a range: at most MOST_RANGES + 1.
    order = Window.orderBy("range")
    ends = first.select(
        F.coalesce(F.lead("range").over(order), F.first("range").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("range"), "text")

    both = (rows.withColumn("end", F.lit(False))
            .unionByName(ends.select(F.lit(None).cast("long").alias("key"), "text", "range",
                                     F.lit(True).alias("end")))
            .repartition("range").withColumns(derive))
    within = Window.partitionBy("range").orderBy("end", F.col("key").desc_nulls_last(), "text")
    return (both.withColumn("next", F.lead(F.struct("text", *derive)).over(within))
            .where(~F.col("end")).select(F.col("key").alias(key), "text", *derive, "next"))


def replace_tail(text: Column, by: Column) -> Column:
    """``text`` with its last third (rounded down) replaced by as many first code points of ``by``."""
    tail = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - tail), F.substring(by, F.lit(1), tail))
