"""Registered queries of the operators: one for each, over whole tables.

Each query calls its operator and derives the digest columns from the
operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transvoc.llm import bpe, centroids, fingerprint, html_text, langid, lexical, mix, near_dedup, packing, pii, quality, secret_scan, warc
from transvoc.llm.oracles import ORACLES  # noqa: F401
from transvoc.llm.words import n_words
from transvoc.session import cut_lineage, table_path

#: Fixed value: the vocabulary files of the tokenizer queries.
VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
#: The queries' key for surrogates; a real run passes a secret one.
PII_KEY = b"documented test key"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of them, by crc32 of the id, is held out."""
    docs = read(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    profiles = langid.learn_profiles(docs.where(~F.col("held_out")))
    return langid.predict(docs, langid.collect_profiles(profiles), keep=("doc_id", "held_out"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 3, 1, 2, ... by source, half as many words again as there are."""
    sized = read(spark, sf_dir, "documents").select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    return mix.mix(sized, size=F.col("size"), keys=("doc_id", "text_hash")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    spans = secret_scan.spans_text(F.col("findings"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"),
                        spans.alias("spans"), "blob")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    return warc.derive(warc.as_responses(read(spark, sf_dir, "pages")), keep=("page_id",))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every document, with cutoffs learned from the labelled ones."""
    measured = cut_lineage(quality.features(read(spark, sf_dir, "documents")), "quality-features")
    cutoffs = quality.calibrate(measured, read(spark, sf_dir, "labels"))
    return quality.judged(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rejected_by", ", ").alias("rejected_by"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in it."""
    return pii.pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and what they tell of likeness."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    own, other, edited = F.col("sketch"), F.col("next.sketch"), F.col("edited_sketch")
    rows = (fingerprint.with_next(docs, {"sketch": fingerprint.sketch(F.col("text"))})
            .withColumn("edited", fingerprint.replace_tail(F.col("text"), F.col("next.text")))
            .withColumn("edited_sketch", fingerprint.sketch(F.col("edited"))))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(own).alias("fingerprint"), fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.resemblance(own, edited).alias("near_edited"),
        fingerprint.resemblance(own, other).alias("near_next"),
        fingerprint.distinct_count(own).alias("n_distinct"),
        fingerprint.containment(own, edited).alias("kept_in_edited"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds with 16 centroids."""
    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens, by pieces."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_byte_bpe, op3_mix_sources, op4_near_dedup, op5_secret_scan, op6_warc_derivatives,
    op7_quality_rules, op8_pii_surrogates, op9_html_text, op10_fingerprint, op11_centroids,
    op12_best_fit_packing, op13_lexical_search)}
