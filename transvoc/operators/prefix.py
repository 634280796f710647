"""Ordered prefix sums that never put a whole group into one task.

``Window.partitionBy(lang).orderBy(...)`` with a running sum sends every row of
a language to one task, which is the first thing to break when one language
holds a third of the corpus.  The two-level scheme used here:

1. every row carries a ``block`` that is monotone in the order key
   (``doc_id div B`` for documents, the file split for text files);
2. block totals: ``groupBy(keys, block).sum`` (partial aggregation, tiny output);
3. block offsets: the block table, one row per block, is written in range partitions
   with their own totals; a partition's offset is a sum over a row per partition,
   a block's a running sum inside its partition;
4. in-block offsets: exclusive running sum ``partitionBy(keys, block)``, so one
   task never holds more than one block;
5. join (3) onto (4) on ``(keys, block)`` - the big side is already clustered on
   these keys by step 4, so the join adds no shuffle of the rows; AQE turns it
   into a broadcast when the block table is small.

The results are exact integers, identical to a sequential running counter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.session import cut_lineage

MAX_BROADCAST_BLOCKS = 1_000_000


def _offsets(totals: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """``(keys..., block, __btotal, __boff)`` of a table of block totals: the totals are written in range partitions
    of keys and block, the partitions' sums (a row a group and partition) give where each begins, and a
    task adds up the blocks of one partition only."""
    n = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    dealt = cut_lineage(totals.repartitionByRange(n, *keys, block).withColumn("__part", F.spark_partition_id()), "blocks")
    parts = dealt.groupBy(*keys, "__part").agg(F.sum("__btotal").alias("__psum")).withColumn(
        "__pbefore", F.coalesce(F.sum("__psum").over(before(Window.partitionBy(*keys).orderBy("__part"))), F.lit(0)))
    within = F.coalesce(F.sum("__btotal").over(before(Window.partitionBy(*keys, "__part").orderBy(block))), F.lit(0))
    return (dealt.withColumn("__within", within).join(F.broadcast(parts.drop("__psum")), [*keys, "__part"])
            .select(*keys, block, "__btotal", (F.col("__pbefore") + F.col("__within")).alias("__boff")))


def block_offsets(df: DataFrame, keys: Sequence[str], block: str | Column, value: str) -> DataFrame:
    """The block table ``(keys..., __block0, __btotal, __boff)``: one row
    per block with the sum of ``value`` over all earlier blocks of the group.
    Callers may write it once and pass it to :func:`exclusive_prefix_sum`."""
    keys = list(keys)
    b = df.withColumn("__block0", block if isinstance(block, Column) else F.col(block))
    return _offsets(b.groupBy(*keys, "__block0").agg(F.sum(value).alias("__btotal")), keys, "__block0")


def exclusive_prefix_sum(df: DataFrame, keys: Sequence[str], block: str | Column,
                         order: Sequence[str], value: str, out: str = "before",
                         offsets: DataFrame | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same ``keys`` group.

    ``order`` must sort rows of one group in the intended order, and ``block``
    must be non-decreasing along that order; blocks may be as many as the rows.
    """
    keys = list(keys)
    df = df.withColumn("__block0", block if isinstance(block, Column) else F.col(block))
    if offsets is None:  # else computed by block_offsets: no second pass for totals
        offsets = block_offsets(df, keys, "__block0", value)
    w_in = (Window.partitionBy(*keys, "__block0").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1))
    inner = df.withColumn("__inoff", F.coalesce(F.sum(value).over(w_in), F.lit(0)))
    res = inner.join(offsets.select(*keys, "__block0", "__boff"), on=[*keys, "__block0"], how="inner")
    res = res.withColumn(out, (F.col("__boff") + F.col("__inoff")).cast("long"))
    return res.drop("__block0", "__boff", "__inoff")


def sum_by_blocks(df: DataFrame, keys: Sequence[str], block: str | Column, value: str, within: str,
                  out: str = "before", alike: Sequence[str] = ()) -> DataFrame:
    """:func:`exclusive_prefix_sum` of rows that have the sum over earlier rows of their block in ``within`` already: they
    only meet the block table, which is broadcast when counted.  ``df`` is read twice.  Groups that differ in ``alike`` alone
    have the same block sums."""
    keys = list(keys)
    own = [k for k in keys if k not in alike]
    df = df.withColumn("__block0", block if isinstance(block, Column) else F.col(block))
    totals = df.groupBy(*keys, "__block0").agg(F.sum(value).alias("__btotal"))
    if own != keys:
        totals = totals.groupBy(*own, "__block0").agg(F.first("__btotal").alias("__btotal"))
    totals = cut_lineage(totals, "block_totals")
    offsets = _offsets(totals, own, "__block0").select(*own, "__block0", "__boff")
    if totals.count() <= MAX_BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    return (df.join(offsets, [*own, "__block0"]).withColumn(out, (F.col("__boff") + F.col(within)).cast("long"))
            .drop("__block0", "__boff", within))


def doc_block(doc_col: str = "doc_id", docs_per_block: int = 256) -> Column:
    """Block key for rows ordered by ``(doc_id, line_no)``."""
    return F.expr(f"`{doc_col}` div {int(docs_per_block)}")
