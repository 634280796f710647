"""Multiple-choice items (SRC-4) and minimal pairs (SRC-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transvoc.functions.text import lang3

# Field names of the multiple-choice JSONL format.
MCQ_FIELDS = ("flores_passage", "question", "mc_answer1", "mc_answer2", "mc_answer3",
              "mc_answer4", "correct_answer_num")
MCQ_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in MCQ_FIELDS])


def read_mcq(spark: SparkSession, path: str, expect: int | None = None) -> DataFrame:
    """SRC-4: JSONL items -> ``(item_id, passage, question, answers array, correct int)``.

    ``correct_answer_num`` may be a number or a numeric string (read as
    string, then cast).  With ``expect`` the item count must match exactly.
    ``item_id`` is the line's position (file, split, row order).
    """
    df = spark.read.schema(MCQ_SCHEMA).option("mode", "FAILFAST").json(path).select(
        "*", F.col("_metadata.file_path").alias("__f"),
        F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__r"))
    if expect is not None:
        n = df.count()
        if n != expect:
            raise ValueError(f"expected {expect} multiple-choice items, found {n}")
    from transvoc.operators.prefix import exclusive_prefix_sum
    numbered = exclusive_prefix_sum(df.withColumn("__one", F.lit(1)).withColumn("__k", F.lit(0)),
                                    ["__k"], F.struct("__f", "__b"), ["__f", "__b", "__r"],
                                    "__one", out="item_id")
    return numbered.select(
        "item_id", F.col("flores_passage").alias("passage"), "question",
        F.array("mc_answer1", "mc_answer2", "mc_answer3", "mc_answer4").alias("answers"),
        F.col("correct_answer_num").cast("double").cast("int").alias("correct"))


def write_mcq(items: DataFrame, path: str) -> None:
    """Items as JSONL in ``item_id`` order (``correct_answer_num`` as text)."""
    out = items.select(
        "item_id", F.col("passage").alias("flores_passage"), "question",
        *[F.element_at("answers", i).alias(f"mc_answer{i}") for i in range(1, 5)],
        F.col("correct").cast("string").alias("correct_answer_num"))
    n = items.sparkSession.sparkContext.defaultParallelism
    out.repartitionByRange(n, "item_id").sortWithinPartitions("item_id").drop("item_id") \
        .write.mode("overwrite").json(path)


def read_min_pairs(df: DataFrame, *langs: str) -> DataFrame:
    """SRC-5: minimal pairs of the given languages, selected by 3-letter code
    (a partition filter when the table is stored by language)."""
    return df.filter(lang3("lang").isin([x[:3] for x in langs]))
