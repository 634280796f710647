"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet and reads it again.

1. ``quality``: documents that fail the base rules, or a rule whose cutoff was
   learned on the labelled ones, go.
2. ``dedup``: of each group of near copies one document stays.
3. ``secrets``: what the scan finds is replaced by ``[SECRET]``.
4. ``mix``: sources are brought to their target weights; a document taken twice
   is there twice, one not taken is gone.
5. ``tokens``: texts are encoded, and decoded again as a check.

Every stage takes an empty table, null values, repeated rows and further columns,
which it passes on.  Very long texts go through whole.  Ties are settled as in the
operators: by the smallest id among near copies, by content among rows that share a
draw in the mix.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transvoc.llm import bpe, mix, near_dedup, quality, secret_scan
from transvoc.llm.queries import VOCABULARY, read
from transvoc.llm.words import n_words
from transvoc.session import cut_lineage, scratch_path

#: No SQL for near-duplicate sketches or byte-pair merges.
ORACLE_SQL: str | None = None


def held(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as ``__row`` beside the named columns, so that no column of
    ``docs`` can clash with one that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass.  Features are computed once to learn the cutoffs and, as
    that is cheaper than to shuffle the texts, once more where the verdict is needed."""
    measured = cut_lineage(quality.features(docs.select("doc_id", "lang", "text")), "quality-features")
    cutoffs = quality.calibrate(measured, read(spark, sf_dir, "labels"))
    rows = quality.features(held(docs, "lang", "text"), keep=("__row", "lang"))
    return quality.judged(rows, cutoffs).where("kept").select("__row.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(held(docs, "text"))
    hit = F.size("findings") > 0
    text = secret_scan.redact(F.col("text"), F.col("findings"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(
        (F.when(hit, new[c]).otherwise(F.col(f"__row.`{c}`")) if c in new else F.col(f"__row.`{c}`")).alias(c)
        for c in docs.columns))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix.mix(held(docs, "doc_id", "source", "text"), size=n_words(F.col("text")),
                    keys=("doc_id", "text"))
    return (mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("__row.*"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return bpe.decode(coded, path).select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written below ``spark.checkpoint.dir`` and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
