"""Nested metrics documents (SRC-8, SNK-3, SET-1, FN-8).

One JSON document per regime: ``{src: {tgt: {label: {metric: value}}}}``; an
empty object is a cell that was not evaluated.  Nesting is three
``map_from_entries(collect_list(...))`` levels; reading is ``from_json`` with
an explicit map schema and three ``explode``s.  Each document holds one
regime's cells (languages squared x labels), a metric-sized group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transvoc.operators.report import METRICS

METRIC_STRUCT = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])
NESTED = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(),
                                                                       METRIC_STRUCT)))


def nest_metrics(df: DataFrame) -> DataFrame:
    """SNK-3: ``(regime, doc map)`` from wide rows."""
    cell = F.struct(*[F.col(m) for m in METRICS])
    l1 = df.groupBy("regime", "src_lang", "tgt_lang").agg(
        F.map_from_entries(F.collect_list(F.struct("method", cell))).alias("m1"))
    l2 = l1.groupBy("regime", "src_lang").agg(
        F.map_from_entries(F.collect_list(F.struct("tgt_lang", "m1"))).alias("m2"))
    return l2.groupBy("regime").agg(
        F.map_from_entries(F.collect_list(F.struct("src_lang", "m2"))).alias("doc"))


def to_documents(nested: DataFrame) -> DataFrame:
    """FN-8: ``(regime, json)``."""
    return nested.select("regime", F.to_json("doc").alias("json"))


def write_metrics(docs: DataFrame, path: str) -> None:
    """One text file per regime under ``regime=<name>/``."""
    docs.repartition("regime").write.mode("overwrite").partitionBy("regime").text(path)


def flatten(nested: DataFrame, doc: str = "doc") -> DataFrame:
    """Three explodes back to wide rows ``(regime, src, tgt, method, metrics...)``."""
    a = nested.select("regime", F.explode(doc).alias("src_lang", "m2"))
    b = a.select("regime", "src_lang", F.explode("m2").alias("tgt_lang", "m1"))
    c = b.select("regime", "src_lang", "tgt_lang", F.explode("m1").alias("method", "m"))
    return c.select("regime", "src_lang", "tgt_lang", "method", *[F.col(f"m.{x}").alias(x)
                                                                  for x in METRICS])


def read_metrics(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """SRC-8 + SET-1: one document per regime, labelled and unioned; a malformed one is an error."""
    out = None
    for regime, path in paths.items():
        doc = spark.read.option("wholetext", "true").text(path).select(
            F.lit(regime).alias("regime"), F.from_json("value", NESTED, {"mode": "FAILFAST"}).alias("doc"))
        part = flatten(doc)
        out = part if out is None else out.unionByName(part)
    return out
