"""Count language model and token scoring (JOB-6, JOB-7, UDF-1).

The scorer contract is the long table ``token_loss``::

    (vocab_lang, <line keys>, pos int, token_id int, prev_id int, loss_nats double)

one row per scored label (``pos`` 0-based in the line's own ids; the first
label is conditioned on the prepended id).  Any model - the add-alpha bigram
model below or a user function through :func:`score_with` - produces it, and
the metric operators consume only it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from transvoc.operators.vocab import CLS_ID, UNK_ID


#: Rows of a bigram table up to which Spark may choose to broadcast it.
SMALL_LM = 200_000
#: Losses that are added up are whole numbers of 1 / UNIT nats, so that sums don't depend on their order.
UNIT = 10 ** 12


def whole(nats: Column) -> Column:
    """A loss as a whole number of 1 / UNIT nats."""
    return F.round(nats * F.lit(float(UNIT))).cast("long")


def label_rows(enc: DataFrame, keys: Sequence[str], ids: str = "ids",
               prepend: int = CLS_ID) -> DataFrame:
    """Array form to label rows ``(keys..., pos, token_id, prev_id)``; the
    previous id is read from the array itself (no window, no shuffle)."""
    return (enc.select(*keys, F.col(ids).alias("__ids"),
                       F.posexplode(ids).alias("pos", "token_id"))
            .withColumn("prev_id", F.when(F.col("pos") == 0, F.lit(prepend))
                        .otherwise(F.element_at("__ids", F.col("pos"))).cast("int"))
            .drop("__ids"))


def train_lm(rows: DataFrame, lang: str = "vocab_lang") -> DataFrame:
    """JOB-6: bigram counts ``(lang, prev int, tok int, n bigint)`` from label
    rows.  Partial aggregation runs map-side, so a hot bigram costs one row
    per task before the shuffle."""
    return (rows.groupBy(F.col(lang).alias("lang"), F.col("prev_id").alias("prev"),
                         F.col("token_id").alias("tok"))
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def context_counts(lm: DataFrame) -> DataFrame:
    """``(lang, prev, n_prev)``: at most vocabulary-size rows per language."""
    return lm.groupBy("lang", "prev").agg(F.sum("n").cast("long").alias("n_prev"))


def unknown_counts(lm: DataFrame, unk: int = UNK_ID) -> DataFrame:
    """``(lang, prev, n_unk)``: how often the unknown word follows; at most vocabulary-size rows per language."""
    return lm.where(F.col("tok") == unk).select("lang", "prev", F.col("n").alias("n_unk"))


def score(rows: DataFrame, lm: DataFrame, vocab_size, alpha: float = 0.1,
          model_col: str = "vocab_lang", ctx: DataFrame | None = None,
          ctx_bound: int | None = None, max_broadcast_rows: int = 5_000_000, lm_rows: int | None = None) -> DataFrame:
    """JOB-7: add-alpha bigram loss ``-ln((c + a) / (n + a V))`` per label row.

    ``vocab_size`` is a number or the name of a column holding V.  Unknown
    labels, the hot key of a text in another language, never meet the bigram
    table: their counts stand in the context table, which has at most V rows
    per model and is broadcast when the caller's ``ctx_bound`` allows it.  The
    other labels join the bigram table, which grows with the corpus: where the
    caller's ``lm_rows`` tell that it is not small, a task hashes its share of the
    table (its keys are unique) and lets the labels, frequent ones too, pass
    unsorted.  Else AQE decides at run time.
    """
    big = lm.where(F.col("tok") != UNK_ID).select(
        F.col("lang").alias(model_col), F.col("prev").alias("prev_id"), F.col("tok").alias("token_id"), F.col("n").alias("__c"))
    if lm_rows is not None and lm_rows > SMALL_LM:
        big = big.hint("shuffle_hash")
    ctx = (context_counts(lm) if ctx is None else ctx).join(unknown_counts(lm), ["lang", "prev"], "left").select(
        F.col("lang").alias(model_col), F.col("prev").alias("prev_id"), F.col("n_prev").alias("__n"),
        F.col("n_unk").alias("__u"))
    if ctx_bound is not None and ctx_bound <= max_broadcast_rows:
        # at most V rows per model: broadcast under the caller's bound
        ctx = F.broadcast(ctx)
    v = F.col(vocab_size) if isinstance(vocab_size, str) else F.lit(float(vocab_size))
    a = F.lit(float(alpha))
    loss = lambda c: -F.log((F.coalesce(c, F.lit(0)) + a) / (F.coalesce("__n", F.lit(0)) + a * v))
    known = (rows.where(F.col("token_id") != UNK_ID).join(big, [model_col, "prev_id", "token_id"], "left")
             .join(ctx, [model_col, "prev_id"], "left").withColumn("loss_nats", loss("__c")))
    unknown = (rows.where(F.col("token_id") == UNK_ID).join(ctx, [model_col, "prev_id"], "left")
               .withColumn("loss_nats", loss("__u")))
    columns = [*rows.columns, "loss_nats"]
    return known.select(*columns).unionByName(unknown.select(*columns))


def score_with(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """UDF-1: a black-box scorer over label rows.

    ``fn`` receives a pandas batch of label rows and returns the loss in nats
    per row.  It runs as Arrow-batched ``mapInPandas`` inside executor tasks,
    so a user model only ever sees bounded batches.
    """
    schema = StructType([*rows.schema.fields, StructField("loss_nats", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            out["loss_nats"] = pd.Series(fn(b), index=b.index).astype("float64")
            yield out

    return rows.mapInPandas(run, schema)
