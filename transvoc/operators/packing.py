"""Packing token streams into fixed-length segments (WIN-3, JOB-3, FN-10).

Semantics reproduced: lines of a corpus are concatenated, each followed by the
separator id; the stream is cut into runs of ``L - 1`` tokens; every segment
gets the prepended id in front; only a short *last* segment is padded (an exact
fit is not).  Labels equal the input ids, padding included.

Instead of materialising the stream, every line gets its global offset
(two-level prefix sum of ``len(ids) + 1``) and emits one row per segment it
overlaps, carrying the overlapping slice.  Segments are then assembled by a
``groupBy(corpus, seg_no)`` whose groups hold at most ``L - 1`` tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.operators.prefix import doc_block, exclusive_prefix_sum, sum_by_blocks
from transvoc.operators.vocab import CLS_ID, PAD_ID, SEP_ID
from transvoc.session import cut_lineage, spread


def token_offsets(enc: DataFrame, corpus: Sequence[str], order: Sequence[str],
                  ids: str = "ids", sep: int = SEP_ID, docs_per_block: int = 256, within: str | None = None,
                  alike: Sequence[str] = ()) -> DataFrame:
    """WIN-3: ``start`` / ``end`` of every line's ids (+ separator) in the
    concatenated stream of its corpus.  The ids are written once, as their lengths are needed before their places.
    Lines whose place in their block is known (``within``) are not dealt to blocks again."""
    df = cut_lineage(enc, "stream_ids").withColumn("__toks", F.concat(F.col(ids), F.array(F.lit(sep))))
    df = df.withColumn("__n", F.size("__toks").cast("long"))
    block = doc_block(order[0], docs_per_block)
    df = (exclusive_prefix_sum(df, corpus, block, order, "__n", out="start") if within is None else
          sum_by_blocks(df, corpus, block, "__n", within, out="start", alike=alike))
    return df.withColumn("end", F.col("start") + F.col("__n"))


def pack_segments(enc: DataFrame, seg_len: int, corpus: Sequence[str] = ("lang",),
                  order: Sequence[str] = ("doc_id", "line_no"), ids: str = "ids",
                  pre: int = CLS_ID, sep: int = SEP_ID, pad: int = PAD_ID,
                  reference_mask: bool = False, docs_per_block: int = 256, within: str | None = None,
                  alike: Sequence[str] = (), below: int | None = None) -> DataFrame:
    """JOB-3: ``(corpus..., seg_no, input_ids, attention_mask, labels, n_real)``.

    ``n_real`` counts stream tokens in the segment (without the prepended id).
    The mask marks the prepended id and the real tokens; ``reference_mask``
    reproduces the original's padded-segment mask, which has one 1 too few.
    ``within`` names the column with a line's place in its block of ``docs_per_block`` documents, if ``enc`` has one;
    corpora that differ in the columns ``alike`` alone have lines of the same lengths.  Ids ``below`` 2^15 are shuffled
    as short integers.
    """
    corpus, order = list(corpus), list(order)
    body_len = seg_len - 1
    df = token_offsets(enc, corpus, order, ids, sep, docs_per_block, within, alike)
    b = F.lit(body_len)
    df = df.withColumn("seg_no", F.explode(F.sequence(
        F.floor(F.col("start") / b).cast("long"),
        F.floor((F.col("end") - 1) / b).cast("long"))))
    lo = F.greatest(F.col("start"), F.col("seg_no") * b)
    hi = F.least(F.col("end"), (F.col("seg_no") + 1) * b)
    df = df.withColumn("__lo", lo).withColumn(
        "__piece", F.slice("__toks", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")))
    if short := below is not None and below <= 2 ** 15:
        df = df.withColumn("__piece", F.col("__piece").cast("array<smallint>"))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__lo", "__piece"))), lambda s: s["__piece"]))
    segs = df.groupBy(*corpus, "seg_no").agg((body.cast("array<int>") if short else body).alias("__body"))
    n = F.size("__body")
    n_pad = F.lit(body_len) - n
    input_ids = F.concat(F.array(F.lit(pre)), F.col("__body"), F.array_repeat(F.lit(pad), n_pad))
    if reference_mask:
        mask = F.when(n_pad > 0, F.concat(F.array_repeat(F.lit(1), n),
                                          F.array_repeat(F.lit(0), n_pad + 1))) \
            .otherwise(F.array_repeat(F.lit(1), F.lit(seg_len)))
    else:
        mask = F.concat(F.array_repeat(F.lit(1), n + 1), F.array_repeat(F.lit(0), n_pad))
    return (segs.withColumn("input_ids", input_ids)
            .withColumn("attention_mask", mask)
            .withColumn("labels", F.col("input_ids"))
            .withColumn("n_real", n.cast("long"))
            .drop("__body"))


def _whole(at: Column, n: Column, body_len: int) -> tuple[Column, Column]:
    """Of a stream's ``n`` tokens from place ``at`` on: the first segment that begins in them, and the first from there on
    that does not end in them; the segments between lie in them whole."""
    b = F.lit(body_len)
    return F.floor((at + b - 1) / b), F.floor((at + n) / b)


def job_pieces(placed: DataFrame, body_len: int, chunk_len: int) -> DataFrame:
    """The pieces of segments that no single chunk holds whole, from lengths alone.

    ``placed`` is ``(job.., file, base, n)``: a job's files of ``n`` tokens and their places in its stream, one
    after the other.  A file's chunks hold ``chunk_len`` tokens, the last one the rest.  A chunk may begin with the end of a
    segment, or lie in it altogether, and may end with the beginning of another: ``(job.., file, chunk, seg_no, at, first, n)``,
    the ``n`` tokens from ``first`` on in the chunk, which come at place ``at`` of the job's stream.
    """
    b, c = F.lit(body_len), F.lit(chunk_len)
    met = (placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / c))))
           .withColumn("__at", F.col("base") + F.col("chunk") * c)
           .withColumn("__n", F.least(c, F.col("n") - F.col("chunk") * c)))
    at, n = F.col("__at"), F.col("__n")
    begin, end = _whole(at, n, body_len)
    last = F.greatest(end * b - at, F.lit(0))  # where the last segment begins
    piece = lambda seg, first, k: F.struct(seg.alias("seg_no"), (at + first).alias("at"), first.cast("int").alias("first"),
                                           k.cast("int").alias("n"))
    both = F.array(piece(begin - 1, F.lit(0), F.least(begin * b - at, n)),
                   piece(end, last, F.when(end >= begin, at + n - end * b).otherwise(F.lit(0))))
    return (met.drop("base", "n").withColumn("__p", F.explode(both)).where("__p.n > 0")
            .select("*", "__p.*").drop("__at", "__n", "__p"))


def pack_jobs(jobs: DataFrame, chunks: DataFrame, seg_len: int, job: Sequence[str], files: str = "train",
              pre: int = CLS_ID, pad: int = PAD_ID, chunk_len: int | None = None) -> DataFrame:
    """SET-2 + JOB-3: ``(job.., seg_no, input_ids, n_real)``, the segments of every job's files in job order.

    ``jobs`` has the job's columns, ``vocab_lang`` and the list ``files``; ``chunks (file, vocab_lang, seg_no,
    input_ids, n_real)`` are the files' own packed streams (:func:`pack_segments`, with segments of ``chunk_len``, by default
    those of the jobs).  Jobs hold ranges, not text: a file is read, encoded and packed once for each vocabulary, whatever
    the number of jobs that use it.  Segments that lie in one chunk are cut where the chunk is read; only the pieces of
    others, of which a chunk has two a job at most, are shuffled.  So the longer the chunks, the less is shuffled.
    """
    job, b = list(job), seg_len - 1
    listed = jobs.select(*job, "vocab_lang", F.posexplode(files).alias("file_ord", "file"))
    chunks = chunks.join(F.broadcast(listed.select("file", "vocab_lang").distinct()), ["file", "vocab_lang"])
    totals = (chunks.groupBy("file", "vocab_lang").agg(F.sum("n_real").alias("n"))
              .groupBy("file").agg(F.first("n").alias("n")))  # words are counted the same under every vocabulary
    before = Window.partitionBy(*job, "vocab_lang").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = (listed.join(F.broadcast(totals), "file").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .drop("file_ord"))  # the files of the jobs' lists, as few as these
    text = chunks.select("file", "vocab_lang", F.col("seg_no").alias("chunk"), "input_ids", F.col("n_real").alias("held"))

    at = F.col("base") + F.col("chunk") * ((chunk_len or seg_len) - 1)
    begin, end = _whole(at, F.col("held"), b)
    used = text.join(F.broadcast(placed), ["file", "vocab_lang"]).withColumn("at", at).where(begin < end)
    body = F.slice("input_ids", (F.col("seg_no") * b - F.col("at") + 2).cast("int"), F.lit(b))
    whole = used.withColumn("seg_no", F.explode(F.sequence(begin, end - 1))).select(
        *job, "seg_no", F.concat(F.array(F.lit(pre)), body).alias("input_ids"), F.lit(b).cast("long").alias("n_real"))

    # Spark takes the pieces for as few as the jobs; as many as the chunks and more, they are never broadcast
    pieces = job_pieces(spread(placed, *job, "file"), b, (chunk_len or seg_len) - 1)
    tail = F.greatest(F.col("held") - b, F.lit(0)).cast("int")  # pieces are shorter than segments: the ends hold them
    ends = text.select("file", "vocab_lang", "chunk", tail.alias("tail"), F.slice("input_ids", F.lit(2), F.lit(b)).alias("head_ids"),
                       F.slice("input_ids", tail + 2, F.lit(b)).alias("tail_ids"))
    rows = pieces.hint("merge").join(ends, ["file", "vocab_lang", "chunk"]).select(*job, "seg_no", "at", F.expr(
        "if(first = 0, slice(head_ids, 1, n), slice(tail_ids, first - tail + 1, n))").alias("part"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]))
    cut, n = rows.groupBy(*job, "seg_no").agg(parts.alias("body")), F.size("body")
    return whole.unionByName(cut.select(*job, "seg_no", F.concat(F.array(F.lit(pre)), "body", F.array_repeat(
        F.lit(pad), F.lit(b) - n)).alias("input_ids"), n.cast("long").alias("n_real")))
