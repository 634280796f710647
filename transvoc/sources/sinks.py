"""Sinks (SNK-1, SNK-2, SNK-4) and the manifest / text writers they need.

All writers go to a caller-given folder; queries that round-trip data put it
below the shared ``spark.checkpoint.dir`` (see :func:`transvoc.session.scratch_path`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, order: Sequence[str] = ("doc_id", "line_no"),
                fmt: str = "parquet", partitions: int | None = None) -> None:
    """SNK-1: sampled lines by ``split`` and ``lang``, in order.

    A range repartition on ``(split, lang, order...)`` plus a sort within
    partitions makes every output file a contiguous, ordered run, and file
    names (part numbers) follow the range order.  The order columns are kept
    in parquet; ``fmt='text'`` writes bare lines.
    """
    keys = ["split", "lang", *order]
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    if fmt == "text":
        out = out.select("split", "lang", "line")
        out.write.mode("overwrite").partitionBy("split", "lang").text(path)
    else:
        out.write.mode("overwrite").partitionBy("split", "lang").parquet(path)


def write_text_corpus(df: DataFrame, path: str, order: Sequence[str] = ("doc_id", "line_no"),
                      partitions: int | None = None) -> None:
    """Lines as text files under ``lang=<code>/``; part files follow line order."""
    keys = ["lang", *order]
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
     .select("lang", "line").write.mode("overwrite").partitionBy("lang").text(path))


def write_manifest(df: DataFrame, path: str) -> None:
    """SNK-2: one JSON document per model folder (``model=<name>/``)."""
    df.repartition("model").write.mode("overwrite").partitionBy("model").json(path)


def write_files(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ("doc_id", "line_no"),
                line_col: str = "line") -> list[str]:
    """One text file for each value of ``keys``, lines in ``order``; returns the
    files, sorted (a group's lines meet in one task: keep groups small)."""
    (df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, line_col)
     .write.mode("overwrite").partitionBy(*keys).text(path))
    return sorted(df.sparkSession.read.text(path).inputFiles())


def write_segments(df: DataFrame, path: str) -> None:
    """SNK-4: packed segments as a training dataset."""
    df.write.mode("overwrite").partitionBy("corpus").parquet(path)
