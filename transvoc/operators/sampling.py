"""Byte-budget sampling of ordered corpora (WIN-1, WIN-2, JN-3, AGG-16).

Semantics of the sequential sampler being reproduced: lines are read in order;
a line goes to *train* while the bytes of earlier train lines are ``<=`` the
train budget (so the last train line may overshoot), afterwards to *valid*
while the bytes of earlier valid lines are ``<=`` the valid budget; the rest is
dropped.  Budgets are ``base * premium(lang)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transvoc.functions.text import byte_len
from transvoc.operators.prefix import block_offsets, doc_block, exclusive_prefix_sum
from transvoc.session import cut_lineage

# Byte premiums per language code.  ``en`` and ``de`` are the
# published premiums (1.00 and 1.053648018); ``es`` and ``fr`` are our own.
DEFAULT_PREMIUMS = {"en": 1.0, "de": 1.053648018, "es": 1.08, "fr": 1.09}


def premiums(spark: SparkSession, mapping: Mapping[str, float]) -> DataFrame:
    """SRC-6: premium table (one row per language, driver-sized)."""
    rows = [(str(k), float(v)) for k, v in sorted(mapping.items())]
    return spark.createDataFrame(rows, "lang string, factor double")


def byte_budget_split(lines: DataFrame, premium: DataFrame, train_bytes: float = 1e7,
                      valid_bytes: float = 1e6, order: Sequence[str] = ("doc_id", "line_no"),
                      docs_per_block: int = 256, places: bool = True) -> DataFrame:
    """WIN-1/WIN-2: label each line ``train`` or ``valid``; other lines are dropped.

    ``lines`` needs ``lang``, the ``order`` columns (the first one, a document
    id, defines blocks) and ``line``.  Output adds ``bytes``, ``before`` and
    ``split``.

    Passes over the corpus: (1) block totals -> the small block-offset table,
    written once; (2) the lines of each language's *crossing* block only (a
    range filter on the document id, which parquet row-group statistics can
    prune) -> the exact bytes that went to train; (3) the line offsets and the
    labels, for the blocks that begin within a budget alone.  The train total per
    language is metadata (one value per language).  Without ``places``, for callers that need no
    ``before``, blocks that lie in a budget whole get their label from the block table, and only lines of
    the others are shuffled.
    """
    order = list(order)
    B = int(docs_per_block)
    df = lines.withColumn("bytes", byte_len("line"))
    blk = doc_block(order[0], B)
    offs = cut_lineage(block_offsets(df, ["lang"], blk, "bytes"), "sample_blocks")
    budgets = {r["lang"]: (float(r["factor"]) * float(train_bytes), float(r["factor"]) * float(valid_bytes))
               for r in premium.collect()}
    tb = df.sparkSession.createDataFrame([(k, v[0]) for k, v in budgets.items()],
                                         "lang string, __t double")
    # JN-3 on the block table (every language appears there): one small job
    # finds missing premiums and each language's crossing block
    o = offs.join(F.broadcast(tb), "lang", "left")
    cross = {r["lang"]: r for r in o.groupBy("lang").agg(
        F.max(F.col("__t").isNull().cast("int")).alias("missing"),
        F.max(F.when(F.col("__boff") <= F.col("__t"), F.col("__block0"))).alias("c"),
        F.max(F.when(F.col("__boff") <= F.col("__t"), F.struct("__block0", "__boff")))
        .getField("__boff").alias("c_off"),
        F.min(F.when(F.col("__boff") > F.col("__t"), F.col("__boff"))).alias("next_off"),
    ).collect()}
    missing = sorted(k for k, r in cross.items() if r["missing"])
    if missing:
        raise KeyError(f"no byte premium for language(s): {missing}")
    totals: dict[str, int | None] = {}
    conds = []
    for lang, r in cross.items():
        totals[lang] = r["next_off"]
        if r["c"] is not None:
            lo, hi = int(r["c"]) * B, (int(r["c"]) + 1) * B
            conds.append((F.col("lang") == lang) & (F.col(order[0]) >= lo) & (F.col(order[0]) < hi))
    if conds:
        cond = conds[0]
        for c in conds[1:]:
            cond = cond | c
        w = Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        coff = df.sparkSession.createDataFrame(
            [(k, int(r["c_off"])) for k, r in cross.items() if r["c"] is not None],
            "lang string, __coff long")
        inner = (df.filter(cond).withColumn("__in", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
                 .join(F.broadcast(coff), "lang").join(F.broadcast(tb), "lang")
                 .withColumn("__before", F.col("__coff") + F.col("__in")))
        for r in (inner.filter(F.col("__before") > F.col("__t")).groupBy("lang")
                  .agg(F.min("__before").alias("m")).collect()):
            prev = totals.get(r["lang"])
            totals[r["lang"]] = r["m"] if prev is None else min(prev, r["m"])
    rows = [(k, budgets[k][0], budgets[k][1], None if totals.get(k) is None else int(totals[k]))
            for k in budgets]
    meta = df.sparkSession.createDataFrame(
        rows, "lang string, t_budget double, v_budget double, train_total long")
    # Only blocks that begin within a budget can hold a sampled line: a range filter on the
    # document id keeps the others out of the scan, before anything is sorted.
    needed = {r["lang"]: r["last"] for r in offs.join(F.broadcast(meta), "lang").where(
        F.col("__boff") <= F.greatest("t_budget", F.coalesce("train_total", F.lit(0)) + F.col("v_budget")))
        .groupBy("lang").agg(F.max("__block0").alias("last")).collect()}
    within = F.lit(False)
    for lang, last in sorted(needed.items()):
        within = within | ((F.col("lang") == lang) & (F.col(order[0]) < (int(last) + 1) * B))
    inside = None
    if not places:
        end = F.col("__boff") + F.col("__btotal")
        late = F.col("__boff") > F.col("t_budget")
        span = offs.join(F.broadcast(meta), "lang").groupBy("lang").agg(
            F.max(F.when(end <= F.col("t_budget"), F.col("__block0"))).alias("t_to"), F.min(F.when(late, F.col("__block0"))).alias("v_from"),
            F.max(F.when(late & (end - F.col("train_total") <= F.col("v_budget")), F.col("__block0"))).alias("v_to"))
        spans = df.sparkSession.createDataFrame([tuple(r) for r in span.collect()], "lang string, t_to long, v_from long, v_to long")
        df = df.filter(within).join(F.broadcast(spans), "lang").withColumn("split", F.when(blk <= F.col("t_to"), F.lit("train")).when(
            blk.between(F.col("v_from"), F.col("v_to")), F.lit("valid"))).drop("t_to", "v_from", "v_to")
        inside, df = df.filter(F.col("split").isNotNull()), df.filter(F.col("split").isNull()).drop("split")
    out = exclusive_prefix_sum(df.filter(within), ["lang"], blk, order, "bytes", out="before", offsets=offs)
    out = out.join(F.broadcast(meta), "lang")
    is_train = F.col("before") <= F.col("t_budget")
    split = (F.when(is_train, F.lit("train"))
             .when(F.col("before") - F.col("train_total") <= F.col("v_budget"), F.lit("valid")))
    out = (out.withColumn("split", split).filter(F.col("split").isNotNull())
           .drop("factor", "t_budget", "v_budget", "train_total"))
    return out if inside is None else inside.unionByName(out.drop("before"))


def sample_summary(split: DataFrame) -> DataFrame:
    """AGG-16: sampled volume per language and split."""
    return split.groupBy("lang", "split").agg(
        F.sum("bytes").cast("long").alias("n_bytes"),
        F.count(F.lit(1)).cast("long").alias("n_lines"),
    )
