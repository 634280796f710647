"""Spark session and shared-storage helpers.

Everything in the package takes a ``SparkSession`` and returns lazy
DataFrames; nothing here is specific to local mode except the fallback
checkpoint folder, which is only created when the session runs locally
and no ``spark.checkpoint.dir`` is configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "transvoc", driver_memory: str = "16g") -> SparkSession:
    """Session with AQE on and the web UI off (no listening server)."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be configured (a folder every executor can reach);
    only a local session without one gets a private folder, as in tests.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a shared folder for the cluster")
    local = tempfile.mkdtemp(prefix="transvoc-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint root for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a parquet table below the shared checkpoint folder and
    read it back: the plan runs once, later references scan the files (with
    real size statistics for AQE), and a lost executor only costs re-reading
    shared files.  ``DataFrame.checkpoint`` would run the last stage twice."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Hash-repartition ``df`` to ``factor x`` the session's parallelism.

    For inputs that are small in bytes but expand into heavy per-row work
    (candidate substrings of distinct words, per-token least squares): AQE
    sizes post-shuffle partitions by *bytes* and would coalesce them into a
    couple of tasks; a repartition with an explicit count is left alone.
    """
    n = factor * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys) if keys else df.repartition(n)
