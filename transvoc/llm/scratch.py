"""Intermediate tables that are removed when their user is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transvoc.session import scratch_path


class Scratch:
    """Tables below one folder of ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back: later plans start from files that all executors share."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}-{name}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Removes the tables; no DataFrame that reads them may be used afterwards."""
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
