"""Report operators over a metrics table (FLT-2..6, AGG-8..14, SRT-1..4, PRJ-3, PRJ-4).

The metrics table is ``metrics_wide``: ``(regime, src_lang, tgt_lang, method,
<13 metrics>)``, one row per cell; a cell whose metrics are all NULL was
not evaluated.  It is metric-sized (languages squared x methods x regimes),
so reports are single small plans; gates are column predicates and every
statistic is an aggregate over ``when(gate, value)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric names, report methods, display names (plain text).
METRICS = ("src_log_ppl", "tgt_log_ppl", "sum_log_ppl", "src_norm_ppl", "tgt_norm_ppl",
           "sum_norm_ppl", "tgt_uid_prop", "src_uid_prop", "src_bpt", "tgt_bpt",
           "src_mbp", "tgt_mbp", "sum_mbp")
REGIMES = ("no-finetuning", "mono-finetuning", "mixed-finetuning")
REPORT_METHODS = ("fvt", "omp", "100mb_src", "10mb_tgt")
METHOD_DISPLAY = {"fvt": "FVT", "omp": "OMP", "100mb_src": "100 MB src", "10mb_tgt": "10 MB tgt"}
REGIME_DISPLAY = {"no-finetuning": "No FT", "mono-finetuning": "Mono FT",
                  "mixed-finetuning": "Mixed FT"}
BASELINES = ("100mb_src", "10mb_tgt")
DEFAULT_EXCLUDED = {"mono-finetuning": ["10mb_tgt"], "mixed-finetuning": ["10mb_tgt"]}
REPORT_THRESHOLD = 0.2
DEFAULT_THRESHOLD = 0.05


def with_pair_sums(df: DataFrame) -> DataFrame:
    """PRJ-3: the three sums of source and target sides."""
    return (df.withColumn("sum_log_ppl", F.col("src_log_ppl") + F.col("tgt_log_ppl"))
              .withColumn("sum_norm_ppl", F.col("src_norm_ppl") + F.col("tgt_norm_ppl"))
              .withColumn("sum_mbp", F.col("src_mbp") + F.col("tgt_mbp")))


def tgt_ok(t: float = DEFAULT_THRESHOLD) -> Column:
    """FLT-2: target unknown share strictly below ``t``; missing counts as 1."""
    return F.coalesce(F.col("tgt_uid_prop"), F.lit(1.0)) < F.lit(t)


def src_ok(t: float = DEFAULT_THRESHOLD) -> Column:
    """FLT-3."""
    return F.coalesce(F.col("src_uid_prop"), F.lit(1.0)) < F.lit(t)


def pair_ok(t: float = DEFAULT_THRESHOLD) -> Column:
    """FLT-4: both gates."""
    return src_ok(t) & tgt_ok(t)


def is_evaluated(metrics: Sequence[str] = METRICS) -> Column:
    """FLT-6: a cell is evaluated when any metric is present."""
    return F.coalesce(*[F.col(m) for m in metrics]).isNotNull()


def _excluded_df(spark, excluded: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(r, m) for r, ms in excluded.items() for m in ms]
    return spark.createDataFrame(rows or [("", "")], "regime string, method string")


def select_methods(df: DataFrame, allowed: Sequence[str] = REPORT_METHODS,
                   excluded: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """FLT-5: allow-list of methods, minus a per-regime exclusion list
    (broadcast left-anti join on ``(regime, method)``)."""
    excluded = DEFAULT_EXCLUDED if excluded is None else excluded
    kept = df.filter(F.col("method").isin(list(allowed)))
    ex = _excluded_df(df.sparkSession, excluded)
    return kept.join(F.broadcast(ex), ["regime", "method"], "left_anti")


def with_labels(df: DataFrame) -> DataFrame:
    """PRJ-4: display label ``<method> (<regime>)`` and ordinals for ordering."""
    mmap = F.create_map(*[F.lit(x) for kv in METHOD_DISPLAY.items() for x in kv])
    rmap = F.create_map(*[F.lit(x) for kv in REGIME_DISPLAY.items() for x in kv])
    mord = F.create_map(*[F.lit(x) for i, m in enumerate(REPORT_METHODS) for x in (m, i + 1)])
    rord = F.create_map(*[F.lit(x) for i, r in enumerate(REGIMES) for x in (r, i + 1)])
    return (df.withColumn("label", F.concat(
                F.coalesce(mmap[F.col("method")], F.col("method")), F.lit(" ("),
                F.coalesce(rmap[F.col("regime")], F.col("regime")), F.lit(")")))
            .withColumn("ord", F.coalesce(rord[F.col("regime")], F.lit(99)) * 10
                        + F.coalesce(mord[F.col("method")], F.lit(9))))


def pair_key(src: str = "src_lang", tgt: str = "tgt_lang") -> Column:
    """PRJ-4: ``SRC-TGT`` with three-letter upper-case codes."""
    return F.concat(F.upper(F.substring(src, 1, 3)), F.lit("-"), F.upper(F.substring(tgt, 1, 3)))


def report_skeleton(spark, allowed: Sequence[str] = REPORT_METHODS,
                    excluded: Mapping[str, Sequence[str]] | None = None,
                    regimes: Sequence[str] = REGIMES) -> DataFrame:
    """AGG-14: every allowed (regime, method) row, even without passing cells."""
    excluded = DEFAULT_EXCLUDED if excluded is None else excluded
    rows = [(r, m) for r in regimes for m in allowed if m not in excluded.get(r, [])]
    return with_labels(spark.createDataFrame(rows, "regime string, method string"))


def _gated_stats(df: DataFrame, specs, allowed, excluded) -> DataFrame:
    cells = select_methods(df, allowed, excluded).filter(is_evaluated())
    aggs = []
    for name, fn, gate, col in specs:
        aggs.append(fn(F.when(gate, F.col(col))).alias(name))
    stats = cells.groupBy("regime", "method").agg(*aggs)
    skel = report_skeleton(df.sparkSession, allowed, excluded)
    return skel.join(stats, ["regime", "method"], "left")


def report_target(df: DataFrame, t: float = REPORT_THRESHOLD, allowed=REPORT_METHODS,
                  excluded=None) -> DataFrame:
    """AGG-8: per regime x method under ``tgt_ok``: median and population std
    of target bits per byte and target minimal-pair accuracy, mean bytes per
    token of the target side, number of cells."""
    g = tgt_ok(t)
    specs = [("tgt_norm_ppl_median", F.median, g, "tgt_norm_ppl"),
             ("tgt_norm_ppl_std", F.stddev_pop, g, "tgt_norm_ppl"),
             ("tgt_mbp_median", F.median, g, "tgt_mbp"),
             ("tgt_mbp_std", F.stddev_pop, g, "tgt_mbp"),
             ("bytes_per_token", F.avg, g, "tgt_bpt"),
             ("n_cells", F.count, g, "tgt_norm_ppl")]
    return _gated_stats(df, specs, allowed, excluded)


def report_pair(df: DataFrame, t: float = REPORT_THRESHOLD, allowed=REPORT_METHODS,
                excluded=None) -> DataFrame:
    """AGG-9: under ``pair_ok``: median / std of the summed bits per byte and
    of the summed minimal-pair accuracy."""
    g = pair_ok(t)
    df = df.withColumn("__mbp2", F.col("src_mbp") + F.col("tgt_mbp"))
    specs = [("sum_norm_ppl_median", F.median, g, "sum_norm_ppl"),
             ("sum_norm_ppl_std", F.stddev_pop, g, "sum_norm_ppl"),
             ("sum_mbp_median", F.median, g, "__mbp2"),
             ("sum_mbp_std", F.stddev_pop, g, "__mbp2"),
             ("n_cells", F.count, g, "sum_norm_ppl")]
    return _gated_stats(df, specs, allowed, excluded)


def bilingual_medians(df: DataFrame, t: float = REPORT_THRESHOLD, allowed=REPORT_METHODS,
                      excluded=None) -> DataFrame:
    """AGG-10: scatter data; the target accuracy median is gated by
    ``tgt_ok`` while its neighbours use ``pair_ok`` (kept as in the source)."""
    p, g = pair_ok(t), tgt_ok(t)
    specs = [("src_ppl", F.median, p, "src_norm_ppl"), ("tgt_ppl", F.median, p, "tgt_norm_ppl"),
             ("src_mbp", F.median, p, "src_mbp"), ("tgt_mbp", F.median, g, "tgt_mbp")]
    return _gated_stats(df, specs, allowed, excluded)


def pair_values(df: DataFrame) -> list[str]:
    """Sorted pivot columns, from the (bounded) language list."""
    langs = sorted({r[0] for r in df.select("src_lang").union(df.select("tgt_lang"))
                    .distinct().collect()})
    return sorted(f"{s[:3].upper()}-{t[:3].upper()}" for s in langs for t in langs if s != t)


def _pivot(df: DataFrame, side: str, gate: Column, allowed, excluded,
           values: Sequence[str] | None) -> DataFrame:
    cells = with_labels(select_methods(df, allowed, excluded).filter(is_evaluated()))
    cells = cells.withColumn("pair", pair_key()).withColumn(
        "__v", F.when(gate, F.col("sum_norm_ppl")))
    values = list(values) if values is not None else pair_values(df)
    return (cells.groupBy(side, "regime", "method", "label", "ord").pivot("pair", values)
            .agg(F.max("__v")))


def pivot_by_source(df: DataFrame, t: float = REPORT_THRESHOLD, allowed=REPORT_METHODS,
                    excluded=None, values: Sequence[str] | None = None) -> DataFrame:
    """AGG-11 / SRT-4: per source language, rows = method labels, columns =
    pairs (sorted), value = summed bits per byte, NULL when not ``pair_ok``."""
    return _pivot(df, "src_lang", pair_ok(t), allowed, excluded, values)


def pivot_by_target(df: DataFrame, t: float = REPORT_THRESHOLD, allowed=REPORT_METHODS,
                    excluded=None, values: Sequence[str] | None = None) -> DataFrame:
    """AGG-12: per target language, gated by ``tgt_ok`` only, still showing
    the summed bits per byte (kept as in the source)."""
    return _pivot(df, "tgt_lang", tgt_ok(t), allowed, excluded, values)


def language_medians(df: DataFrame, t: float = REPORT_THRESHOLD, allowed=REPORT_METHODS,
                     excluded=None, langs: Sequence[str] | None = None) -> DataFrame:
    """AGG-13: median across each per-source pivot row (gated cells only, as
    shown: at three decimals), computed before pivoting: ``groupBy(src,
    method).median`` then ``pivot(src)``.  NULL when a row has no numeric cell."""
    cells = with_labels(select_methods(df, allowed, excluded).filter(is_evaluated()))
    cells = cells.withColumn("__v", F.when(pair_ok(t), round_half_up("sum_norm_ppl", 3)))
    per = cells.groupBy("label", "regime", "method", "src_lang").agg(F.median("__v").alias("m"))
    per = per.withColumn("col", F.upper("src_lang"))
    if langs is None:
        langs = sorted(r[0] for r in df.select("src_lang").distinct().collect())
    return per.groupBy("label", "regime", "method").pivot("col", [x.upper() for x in langs]).agg(
        F.max("m"))


def round_half_up(col, digits: int) -> Column:
    """Round half away from zero; a 1e-9 nudge keeps binary representation
    error (0.5475 stored as 0.54749999...) from flipping a half."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.signum(c) * F.lit(1e-9), digits)


def format_stat(median_col, std_col=None, digits: int = 3):
    """FN-7 display text: ``"m (std=s)"`` or ``"m"``; NULL shows as ``N/A``.
    Presentation only - comparisons use the numeric columns."""
    m = F.format_number(round_half_up(median_col, digits), digits)
    text = m if std_col is None else F.concat(
        m, F.lit(" (std="), F.format_number(round_half_up(std_col, digits), digits), F.lit(")"))
    c = F.col(median_col) if isinstance(median_col, str) else median_col
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.regexp_replace(text, ",", ""))


def to_number(text) -> Column:
    """FN-9: the number that a shown cell begins with; NULL where there is none (``N/A``)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def rank_report(table: DataFrame, best_min: Sequence[str] = (), best_max: Sequence[str] = (),
                digits: int = 3, baselines: Sequence[str] = BASELINES) -> DataFrame:
    """SRT-1 / SRT-2: baselines first, then the rest, both in original order
    (``rank``); ``is_best_<col>`` marks every row equal to the column's min
    (or max) after rounding to ``digits``.  NULLs never win.  The report is
    metric-sized, so the windows over the whole table are cheap."""
    base = F.lit(False)
    for b in baselines:
        base = base | F.col("label").contains(METHOD_DISPLAY.get(b, b))
    out = table.withColumn("is_baseline", base)
    whole = Window.partitionBy()
    out = out.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("is_baseline").desc(), F.col("ord"))))
    for c in best_min:
        r = round_half_up(c, digits)
        out = out.withColumn(f"is_best_{c}", F.coalesce(r == F.min(r).over(whole), F.lit(False)))
    for c in best_max:
        r = round_half_up(c, digits)
        out = out.withColumn(f"is_best_{c}", F.coalesce(r == F.max(r).over(whole), F.lit(False)))
    return out


def best_cell(table: DataFrame, row_key: str, value_cols: Sequence[str],
              digits: int = 3, order: str | None = None) -> DataFrame:
    """SRT-3: the single smallest cell (after rounding), first in row-major
    order (rows by ``order``, else ``row_key``; columns in the given order).
    The table is stacked to long form and reduced with ``min_by``."""
    place = order or row_key
    stacked = table.select(row_key, F.col(place).alias("__place"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.lit(c).alias("col"),
                 round_half_up(c, digits).alias("value"))
        for i, c in enumerate(value_cols)])).alias("s")).select(row_key, "__place", "s.*")
    stacked = stacked.filter(F.col("value").isNotNull())
    return stacked.agg(F.min_by(F.struct(row_key, "col", "value"),
                                F.struct("value", "__place", "ci")).alias("b")).select("b.*")
