"""Corpus queries: line sources, byte-budget sampling, sinks, packing
(SRC-1..3, WIN-1..3, JN-3, AGG-16, SNK-1, SNK-4, JOB-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transvoc import oracle as O
from transvoc import testbed as tb
from transvoc.catalog import finish, register
from transvoc.functions.text import byte_len
from transvoc.operators.packing import pack_segments
from transvoc.operators.sampling import sample_summary
from transvoc.operators.tokenize import encode
from transvoc.session import scratch_path
from transvoc.sources.corpus import (read_corpus, read_devtest, read_training_lines,
                                     split_unicode_lines, strip_file_edges)
from transvoc.sources.sinks import write_files, write_segments, write_split, write_text_corpus


@register("corpus_lines", O.with_ctes(["lines"], """
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) - 1 AS BIGINT) AS line_no,
       line, CAST(strlen(line) AS BIGINT) AS bytes
FROM lines"""))
def corpus_lines(spark, sf_dir):
    """SRC-1: documents written as per-language text corpora, then scanned
    back with language from the folder and order from (file, split, row)."""
    path = scratch_path(spark, "corpus_lines")
    write_text_corpus(tb.lines(spark, sf_dir), path)
    df = read_corpus(spark, path, lang_from="partition")
    return finish(df.select("lang", "line_no", "line", byte_len("line").alias("bytes")))


@register("training_lines", O.with_ctes([], f"""
SELECT lang, doc_id, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line
FROM (SELECT lang, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT lang, doc_id, string_split({O.strip('text')}, chr(10)) AS parts FROM documents))
"""))
def training_lines(spark, sf_dir):
    """SRC-2: every document as a training file: whole-file strip, then split."""
    out = strip_file_edges(tb.raw_lines(spark, sf_dir), ["lang", "doc_id"], "line_no", "raw")
    return finish(out.select("lang", "doc_id", "line_no", "line"))


@register("devtest_lines", O.with_ctes([], f"""
SELECT lang, doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(j - 1 AS BIGINT) AS sub_no,
       {O.strip('pieces[j]')} AS line
FROM (SELECT lang, doc_id, line_no, pieces, unnest(range(1, len(pieces) + 1)) AS j
      FROM (SELECT lang, doc_id, i - 1 AS line_no,
                   regexp_split_to_array(parts[i], '[\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS pieces
            FROM (SELECT lang, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                  FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS parts FROM documents
                        WHERE doc_id % 10 = {tb.DEVTEST_MOD}))))
"""))
def devtest_lines(spark, sf_dir):
    """SRC-3: held-out lines, also broken on the Unicode line separators."""
    d = tb.raw_lines(spark, sf_dir).filter(F.col("doc_id") % 10 == tb.DEVTEST_MOD)
    out = split_unicode_lines(d, "raw")
    return finish(out.select("lang", "doc_id", "line_no", "sub_no", "line"))


@register("training_files", O.with_ctes([], f"""
, raw AS (
  SELECT lang, doc_id // {tb.DOCS_PER_FILE} AS file_no, doc_id, i, parts[i] AS line
  FROM (SELECT lang, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS parts FROM documents))),
files AS (
  SELECT lang, file_no, {O.strip("string_agg(line, chr(10) ORDER BY doc_id, i)")} AS body
  FROM raw GROUP BY lang, file_no),
split AS (SELECT lang, file_no, string_split(body, chr(10)) AS parts FROM files)
SELECT lang, CAST(file_no AS BIGINT) AS file_no, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line
FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM split)""".replace(", raw AS", "WITH raw AS", 1)))
def training_files(spark, sf_dir):
    """SRC-2 through the reader: documents written as text files of some thousand
    documents of one language, read back in list order, each stripped as a whole."""
    rows = tb.raw_lines(spark, sf_dir).withColumn("file_no", F.expr(f"doc_id div {tb.DOCS_PER_FILE}"))
    files = write_files(rows, scratch_path(spark, "training_files"), ["lang", "file_no"], line_col="raw")
    names = spark.createDataFrame(list(enumerate(files)), "file_ord int, path string").select(
        "file_ord", F.regexp_extract("path", r"/lang=([^/]+)/", 1).alias("lang"),
        F.regexp_extract("path", r"/file_no=(\d+)/", 1).cast("long").alias("file_no"))
    out = read_training_lines(spark, files).join(names, "file_ord")
    return finish(out.select("lang", "file_no", "line_no", "line"))


@register("devtest_files", O.with_ctes([], f"""
WITH sub AS (
  SELECT lang, doc_id, line_no, j, {O.strip('pieces[j]')} AS line
  FROM (SELECT lang, doc_id, line_no, pieces, unnest(range(1, len(pieces) + 1)) AS j
        FROM (SELECT lang, doc_id, i AS line_no,
                     regexp_split_to_array(parts[i], '[\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS pieces
              FROM (SELECT lang, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
                    FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS parts FROM documents
                          WHERE doc_id % 10 = {tb.DEVTEST_MOD})))))
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no, j) - 1 AS BIGINT) AS line_no, line
FROM sub"""))
def devtest_files(spark, sf_dir):
    """SRC-3 through the reader: held-out lines written as text, read back with
    the Unicode line breaks."""
    path = scratch_path(spark, "devtest_files")
    d = tb.raw_lines(spark, sf_dir).filter(F.col("doc_id") % 10 == tb.DEVTEST_MOD)
    write_text_corpus(d.withColumnRenamed("raw", "line"), path)
    back = read_devtest(spark, path, lang_from="partition", glob="*.txt")
    return finish(back.select("lang", "line_no", "line"))


@register("byte_budget_split", O.with_ctes(["sampled"], """
SELECT lang, doc_id, CAST(line_no AS BIGINT) AS line_no, split, CAST(bytes AS BIGINT) AS bytes,
       CAST(before AS BIGINT) AS before FROM sampled"""))
def byte_budget_split(spark, sf_dir):
    """WIN-1/WIN-2/JN-3: train and valid lines under premium-scaled budgets."""
    s = tb.sampled(spark, sf_dir)
    return finish(s.select("lang", "doc_id", "line_no", "split", "bytes", "before"))


SUMMARY_SQL = """
SELECT lang, split, CAST(sum(bytes) AS BIGINT) AS n_bytes, CAST(count(*) AS BIGINT) AS n_lines
FROM sampled GROUP BY lang, split"""


@register("sample_summary", O.with_ctes(["sampled"], SUMMARY_SQL))
def sample_summary_q(spark, sf_dir):
    """AGG-16: sampled bytes and lines per language and split."""
    return finish(sample_summary(tb.sampled(spark, sf_dir)))


@register("sink_roundtrip", O.with_ctes(["sampled_share"], """
SELECT split, lang, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(bytes) AS BIGINT) AS n_bytes,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM sampled_share GROUP BY split, lang"""))
def sink_roundtrip(spark, sf_dir):
    """SNK-1: write the split by (split, lang) in order, read it back."""
    path = scratch_path(spark, "sink_roundtrip")
    write_split(tb.sampled_share(spark, sf_dir).select("lang", "doc_id", "line_no", "line", "bytes",
                                                 "split"), path)
    back = spark.read.parquet(path)
    return finish(back.groupBy("split", "lang").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("bytes").alias("n_bytes"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")))


_B = tb.PACK_LEN - 1
PACK_SQL = O.with_ctes(["sampled_share", "vocab"], f"""
, tr AS (SELECT lang, doc_id, line_no, {O.words('line')} AS ws FROM sampled_share WHERE split = 'train'),
starts AS (
  SELECT lang, doc_id, line_no, len(ws) + 1 AS n,
         coalesce(sum(len(ws) + 1) OVER (PARTITION BY lang ORDER BY doc_id, line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM tr),
toks AS (SELECT lang, doc_id, line_no, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM tr),
stream AS (
  SELECT t.lang, s.start + t.pos AS idx, coalesce(v.id, 1) AS token_id
  FROM toks t JOIN starts s ON s.lang = t.lang AND s.doc_id = t.doc_id AND s.line_no = t.line_no
  LEFT JOIN vocab v ON v.lang = t.lang AND v.token = t.token
  UNION ALL
  SELECT lang, start + n - 1 AS idx, 3 AS token_id FROM starts),
segs AS (SELECT lang, idx // {_B} AS seg_no, list(token_id ORDER BY idx) AS body
         FROM stream GROUP BY lang, idx // {_B})
SELECT lang, CAST(seg_no AS BIGINT) AS seg_no,
       array_to_string(list_concat([2], body, list_transform(range({_B} - len(body)), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_transform(range({tb.PACK_LEN}), lambda i: CASE WHEN i <= len(body) THEN 1 ELSE 0 END), ',')
         AS attention_mask,
       CAST(len(body) AS BIGINT) AS n_real
FROM segs""")


def _packed(spark, sf_dir, reference_mask):
    train = tb.sampled_share(spark, sf_dir).filter(F.col("split") == "train").select(
        "lang", "doc_id", "line_no", "line")
    m = tb.models(spark, sf_dir)
    enc = encode(train, m.vocab, "word", "same", known_entries=m.known)
    segs = pack_segments(enc, tb.PACK_LEN, ["lang"], docs_per_block=tb.DOCS_PER_BLOCK,
                         reference_mask=reference_mask)
    path = scratch_path(spark, "segments")
    write_segments(segs.withColumnRenamed("lang", "corpus"), path)
    back = spark.read.parquet(path).withColumnRenamed("corpus", "lang")
    return finish(back.select("lang", "seg_no", F.array_join("input_ids", ",").alias("input_ids"),
                              F.array_join("attention_mask", ",").alias("attention_mask"),
                              "n_real"))


@register("pack_segments", PACK_SQL)
def pack_segments_q(spark, sf_dir):
    """WIN-3 / JOB-3 / SNK-4: the train split of every language packed into
    segments of ``PACK_LEN`` ids, written as a dataset and read back."""
    return _packed(spark, sf_dir, False)


@register("pack_segments_short_mask", PACK_SQL.replace(
    "CASE WHEN i <= len(body) THEN 1 ELSE 0 END",
    f"CASE WHEN i < len(body) OR len(body) = {_B} THEN 1 ELSE 0 END"))
def pack_segments_short_mask(spark, sf_dir):
    """The same with the original's mask, one short in a padded segment."""
    return _packed(spark, sf_dir, True)
