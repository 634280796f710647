"""Line-oriented text sources (SRC-1, SRC-2, SRC-3).

Line order is data, so every reader returns an explicit order key.  Text
splits are packed into partitions by size, so a bare
``monotonically_increasing_id`` is not file order; the key is
``(file, split start, id within the split)``, which is.  Line numbers, where
needed, come from the two-level prefix sum (never a per-file window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transvoc.functions.text import UNICODE_BREAKS, is_blank, py_lstrip, py_rstrip, py_strip
from transvoc.operators.prefix import exclusive_prefix_sum


def _text_with_order(spark: SparkSession, paths, glob: str | None = None,
                     recursive: bool = False) -> DataFrame:
    reader = spark.read.format("text")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(paths)
    return df.select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_in_split"),
    )


def _lang_of(file_col: Column, lang_from: str) -> Column:
    if lang_from == "stem":
        return F.regexp_extract(file_col, r"([^/]+?)(\.[^./]*)?$", 1)
    if lang_from == "partition":
        return F.regexp_extract(file_col, r"/lang=([^/]+)/", 1)
    raise ValueError(lang_from)


def number_lines(df: DataFrame, keys: Sequence[str], out: str = "line_no",
                 within: Sequence[str] = ()) -> DataFrame:
    """0-based line number within ``keys`` by the ``(file, block_start,
    row_in_split, within...)`` order, via the two-level prefix sum over file splits."""
    return exclusive_prefix_sum(
        df.withColumn("__one", F.lit(1)), keys, F.struct("file", "block_start"),
        ["file", "block_start", "row_in_split", *within], "__one", out=out).drop("__one")


def read_corpus(spark: SparkSession, path: str, lang_from: str = "stem",
                glob: str = "*.txt", strip: bool = True) -> DataFrame:
    """SRC-1: every ``*.txt`` under ``path``; language = file stem (or the
    ``lang=`` partition folder); each line stripped, blank lines kept.

    Output ``(lang, file, block_start, row_in_split, line_no, line)``.
    """
    df = _text_with_order(spark, path, glob=glob, recursive=(lang_from == "partition"))
    df = df.withColumn("lang", _lang_of(F.col("file"), lang_from))
    df = df.withColumn("line", py_strip("raw") if strip else F.col("raw")).drop("raw")
    return number_lines(df, ["lang"])


def read_devtest(spark: SparkSession, path: str, lang_from: str = "stem",
                 glob: str = "*.devtest", unicode_breaks: bool = True) -> DataFrame:
    """SRC-3: like SRC-1, but a line also breaks on VT, FF, FS, GS, RS, NEL,
    LS and PS (the codecs reader's rules); each piece is stripped."""
    df = _text_with_order(spark, path, glob=glob, recursive=(lang_from == "partition"))
    df = df.withColumn("lang", _lang_of(F.col("file"), lang_from))
    if unicode_breaks:
        df = df.select("*", F.posexplode(F.split("raw", UNICODE_BREAKS, -1)).alias("sub_no", "piece"))
    else:
        df = df.withColumn("sub_no", F.lit(0)).withColumn("piece", F.col("raw"))
    df = df.withColumn("line", py_strip("piece")).drop("raw", "piece")
    # sub-lines keep the order of their physical line
    return number_lines(df, ["lang"], within=["sub_no"])


def split_unicode_lines(lines: DataFrame, line_col: str = "raw") -> DataFrame:
    """SRC-3 applied to lines already in a table: ``sub_no`` and a stripped ``line``."""
    return (lines.select("*", F.posexplode(F.split(line_col, UNICODE_BREAKS, -1))
                         .alias("sub_no", "__piece"))
            .withColumn("line", py_strip("__piece")).drop("__piece"))


def strip_file_edges(lines: DataFrame, file_keys: Sequence[str], line_no: str = "line_no",
                     line_col: str = "raw") -> DataFrame:
    """SRC-2 semantics on line rows: ``read_text().strip().split('\\n')``.

    Leading and trailing blank lines of each file are dropped, the first kept
    line loses its leading whitespace and the last its trailing whitespace;
    inner lines are untouched.  An all-blank file yields one empty line.
    The per-file first/last non-blank positions are a partial aggregation,
    joined back (broadcast by AQE when the file count is small).
    """
    keys = list(file_keys)
    blank = is_blank(line_col)
    edges = lines.groupBy(*keys).agg(
        F.min(F.when(~blank, F.col(line_no))).alias("__first"),
        F.max(F.when(~blank, F.col(line_no))).alias("__last"),
        F.min(line_no).alias("__min"))
    df = lines.join(edges, keys)
    keep = ((F.col("__first").isNull() & (F.col(line_no) == F.col("__min")))
            | ((F.col(line_no) >= F.col("__first")) & (F.col(line_no) <= F.col("__last"))))
    c = F.col(line_col)
    text = (F.when(F.col("__first").isNull(), F.lit(""))
            .when((F.col(line_no) == F.col("__first")) & (F.col(line_no) == F.col("__last")),
                  py_strip(c))
            .when(F.col(line_no) == F.col("__first"), py_lstrip(c))
            .when(F.col(line_no) == F.col("__last"), py_rstrip(c))
            .otherwise(c))
    new_no = F.when(F.col("__first").isNull(), F.lit(0)).otherwise(F.col(line_no) - F.col("__first"))
    return (df.filter(keep).withColumn("line", text).withColumn(line_no, new_no.cast("int"))
            .drop("__first", "__last", "__min"))


def _file_uri(spark: SparkSession, path: str) -> str:
    """``path`` qualified and escaped, as ``_metadata.file_path`` is (but for slashes, see _slashes)."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def _slashes(uri: Column) -> Column:
    """Local files are reported as ``file:/x`` or ``file:///x``."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def read_training_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """SRC-2: several files concatenated in list order, each stripped as a
    whole then split on ``\\n``.  Output ``(file_ord, line_no, line)``.

    A file listed twice is there twice; an empty file is one empty line.
    """
    uris = [_file_uri(spark, f) for f in files]
    ords = spark.createDataFrame(list(zip(uris, range(len(uris)), strict=True)), "uri string, file_ord int")
    df = number_lines(_text_with_order(spark, sorted(set(files))), ["file"])
    out = strip_file_edges(df, ["file"], "line_no", "raw")
    # one row a listed file; a file without any row is the empty file
    return (ords.join(out, _slashes(F.col("uri")) == _slashes(F.col("file")), "left")
            .select("file_ord", F.coalesce("line_no", F.lit(0)).alias("line_no"),
                    F.coalesce("line", F.lit("")).alias("line")))
