"""Parquet table scans with a parallelism guard.

Parquet is split at row-group granularity: a file with one large row group is
read by a single task however many splits Spark plans, and everything up to
the first shuffle (line splitting, token explosion, partial aggregation) then
runs on one core.  When the footer shows fewer row groups than the session's
parallelism, the scan is hash-repartitioned on a key (one shuffle of the
table).  Well-formed large inputs - many files and row groups - are left
untouched, so this costs nothing at scale.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession


def row_groups(path: str) -> int | None:
    """Total row groups of a local parquet file or folder; ``None`` if the
    path is not local (the footer is then not inspected)."""
    try:
        import pyarrow.parquet as pq
    except ImportError:  # pragma: no cover
        return None
    if os.path.isfile(path):
        files = [path]
    elif os.path.isdir(path):
        files = glob.glob(os.path.join(path, "**", "*.parquet"), recursive=True)
    else:
        return None
    try:
        return sum(pq.ParquetFile(f).metadata.num_row_groups for f in files)
    except Exception:  # noqa: BLE001 - unreadable footers: no guess
        return None


def read_parquet(spark: SparkSession, path: str, balance_key: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if balance_key is None:
        return df
    target = spark.sparkContext.defaultParallelism
    # Footers are opened only where the files are fewer than the cores.
    files = df.inputFiles()
    groups = row_groups(path) if len(files) < target else None
    if groups is not None and groups < target:
        return df.repartition(2 * target, balance_key)
    return df
