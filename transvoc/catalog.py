"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus oracles.

Outputs are normalised by :func:`finish` (integers as bigint, doubles rounded
to 6 decimals) and the oracle SQL does the same, so the driver's
order-insensitive hash compares like with like.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; each call gets a fresh scope for shared
    model artifacts, so nothing is reused across queries."""
    def deco(fn):
        @functools.wraps(fn)
        def scoped(spark, sf_dir):
            from transvoc import testbed
            testbed.reset_scope()
            try:
                return fn(spark, sf_dir)
            finally:
                testbed.reset_scope()
        QUERIES[name] = scoped
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Cast integers to bigint, floats to double rounded to ``digits``."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)  # no negative zero
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import the modules that register queries."""
    from transvoc import queries  # noqa: F401
