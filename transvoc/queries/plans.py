"""Experiment-plan queries (PRJ-1/2, JN-1/2/5/6, SET-2..4, AGG-15/17, SRC-7, SNK-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transvoc import oracle as O
from transvoc import testbed as tb
from transvoc.catalog import finish, register
from transvoc.operators.packing import pack_jobs, pack_segments
from transvoc.operators.prefix import doc_block
from transvoc.operators.tokenize import encode
from transvoc.plans import experiment as X
from transvoc.session import cut_lineage, scratch_path
from transvoc.sources.manifest_tree import write_manifest_tree
from transvoc.sources.sinks import write_manifest

REGIME_OF = {False: ["no-finetuning"], True: ["mono-finetuning", "mixed-finetuning"]}


@register("language_mapping", O.with_ctes(["mapping"], "SELECT * FROM mapping"))
def language_mapping(spark, sf_dir):
    """PRJ-1: model and data names of every language."""
    return finish(tb.mapping(spark, sf_dir))


@register("pair_plan", O.with_ctes(["tplan"], """
SELECT src_lang, tgt_lang, src_model, tgt_model, method, model FROM tplan"""))
def pair_plan(spark, sf_dir):
    """JN-1 / JN-2 / PRJ-2: ordered language pairs x transfer methods."""
    t = tb.transfer(spark, sf_dir)
    return finish(t.select("src_lang", "tgt_lang", "src_model", "tgt_model", "method", "model"))


MANIFEST_COLS = ("model", "src_lang", "tgt_lang", "src_model", "tgt_model", "method", "finetuned")


@register("manifest_scan", O.with_ctes(["manifest"], """
SELECT model, src_lang, tgt_lang, src_model, tgt_model, method, finetuned,
       src_train, src_valid, tgt_train, tgt_valid FROM manifest"""))
def manifest_scan(spark, sf_dir):
    """SNK-2 + SRC-7: manifests written one per model folder, scanned back."""
    path = scratch_path(spark, "manifests")
    write_manifest(tb.manifest(spark, sf_dir), path)
    m = X.read_manifest(spark, path)
    return finish(m.select(*MANIFEST_COLS,
                           F.col("src_finetune_data.train").alias("src_train"),
                           F.col("src_finetune_data.valid").alias("src_valid"),
                           F.col("tgt_finetune_data.train").alias("tgt_train"),
                           F.col("tgt_finetune_data.valid").alias("tgt_valid")))


def _ft_plan(spark, sf_dir, skip_existing=True):
    existing = tb.existing(spark, sf_dir) if skip_existing else None
    return X.finetune_plan(tb.manifest(spark, sf_dir), existing, overwrite=False)


@register("manifest_tree", O.with_ctes(["ft_plan", "manifest"], """
SELECT model, src_lang, tgt_lang, src_model, tgt_model, method, finetuned, '' AS folder FROM manifest WHERE NOT finetuned
UNION ALL
SELECT j.out, m.src_lang, m.tgt_lang, m.src_model, m.tgt_model, m.method, true, j.regime
FROM ft_plan j JOIN manifest m ON m.model = j.model_spec WHERE NOT m.finetuned"""))
def manifest_tree(spark, sf_dir):
    """SNK-2 + SRC-7 in the original layout: manifests written as ``<model>/transfer_info.json``, found again,
    and written for the fine-tuned models of both regimes, flipped, where the model they start from has one."""
    root = scratch_path(spark, "manifest_tree")
    write_manifest_tree(tb.manifest(spark, sf_dir).filter(~F.col("finetuned")), f"{root}/models")
    found = X.read_manifest(spark, f"{root}/models", "folders")
    tuned = X.tuned_manifests(_ft_plan(spark, sf_dir), found)
    write_manifest_tree(tuned, f"{root}/tuned")
    both = found.withColumn("folder", F.lit(""))
    for regime in REGIME_OF[True]:
        back = X.read_manifest(spark, f"{root}/tuned/{regime}", "folders")
        both = both.unionByName(back.withColumn("folder", F.lit(regime)))
    return finish(both.select(*MANIFEST_COLS, "folder"))


@register("finetune_plan", O.with_ctes(["ft_plan"], """
SELECT regime, src_lang, kind, model_spec, out, array_to_string(train, ',') AS train,
       array_to_string(valid, ',') AS valid FROM ft_plan"""))
def finetune_plan(spark, sf_dir):
    """SET-3 / AGG-15 / JN-5 / FLT-1: fine-tuning jobs per source language
    and regime, first job per output, existing outputs skipped."""
    j = _ft_plan(spark, sf_dir)
    return finish(j.select("regime", "src_lang", "kind", "model_spec", "out",
                           F.array_join("train", ",").alias("train"),
                           F.array_join("valid", ",").alias("valid")))


@register("data_routing", O.with_ctes(["ft_plan", "sampled_share"], """
, files AS (
  SELECT 'data/' || split || '/' || lower(lang || '.txt') AS file, count(*) AS n_lines,
         sum(strlen(line)) AS n_bytes, min(doc_id) AS first_doc
  FROM sampled_share GROUP BY 1),
jf AS (SELECT regime, src_lang, out, unnest(train) AS file, unnest(range(len(train))) AS file_ord FROM ft_plan)
SELECT jf.regime, jf.src_lang, jf.out, CAST(jf.file_ord AS BIGINT) AS file_ord, jf.file,
       CAST(f.n_lines AS BIGINT) AS n_lines, CAST(f.n_bytes AS BIGINT) AS n_bytes, f.first_doc
FROM jf LEFT JOIN files f ON f.file = jf.file"""))
def data_routing(spark, sf_dir):
    """SET-2: which sampled files, in which order, feed every job."""
    r = X.route_summary(_ft_plan(spark, sf_dir), tb.split_files(spark, sf_dir))
    return finish(r.select("regime", "src_lang", "out", "file_ord", "file", "n_lines", "n_bytes",
                           "first_doc"))


@register("routed_lines", O.with_ctes(["ft_plan", "sampled_share"], """
, files AS (
  SELECT 'data/' || split || '/' || lower(lang || '.txt') AS file, doc_id, line_no, line FROM sampled_share),
jf AS (
  SELECT regime, src_lang, out, 'train' AS split, unnest(train) AS file, unnest(range(len(train))) AS file_ord
  FROM ft_plan
  UNION ALL
  SELECT regime, src_lang, out, 'valid', unnest(valid), unnest(range(len(valid))) FROM ft_plan)
SELECT jf.regime, jf.src_lang, jf.out, jf.split, CAST(jf.file_ord AS BIGINT) AS file_ord, f.doc_id,
       CAST(f.line_no AS BIGINT) AS line_no, md5(f.line) AS line_md5
FROM jf JOIN files f ON f.file = jf.file"""))
def routed_lines(spark, sf_dir):
    """SET-2: the lines of every job's train and valid files, with their order
    ``(file_ord, doc_id, line_no)``."""
    jobs, corpus = _ft_plan(spark, sf_dir), tb.split_files(spark, sf_dir)
    both = None
    for split in ("train", "valid"):
        rows = X.route_lines(jobs, corpus, split).withColumn("split", F.lit(split))
        both = rows if both is None else both.unionByName(rows)
    return finish(both.select("regime", "src_lang", "out", "split", "file_ord", "doc_id", "line_no",
                              F.md5("line").alias("line_md5")))


_B = tb.PACK_LEN - 1
CHUNK_SEGMENTS = 16  # segments in a chunk of a file's stream, from which jobs cut theirs; Parquet readers hold some thousand chunks
# The vocabulary of a job's model: the source's for its base, else the target's.
_VOCAB_OF = "CASE kind WHEN 'transfer' THEN split_part(model_spec, '-', 2) ELSE regexp_extract(model_spec, '/([^/_]+)_', 1) END"


@register("packed_jobs", O.with_ctes(["ft_plan", "sampled_share", "vocab"], f"""
, files AS (
  SELECT 'data/' || split || '/' || lower(lang || '.txt') AS file, doc_id, line_no, {O.words('line')} AS ws FROM sampled_share),
jf AS (
  SELECT regime, src_lang, out, {_VOCAB_OF} AS vocab_lang, 'train' AS split, unnest(train) AS file,
         unnest(range(len(train))) AS file_ord FROM ft_plan
  UNION ALL
  SELECT regime, src_lang, out, {_VOCAB_OF}, 'valid', unnest(valid), unnest(range(len(valid))) FROM ft_plan),
job_lines AS (
  SELECT jf.regime, jf.src_lang, jf.out, jf.split, jf.vocab_lang, f.ws,
         coalesce(sum(len(f.ws) + 1) OVER (PARTITION BY jf.regime, jf.out, jf.split ORDER BY jf.file_ord, f.doc_id, f.line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM jf JOIN files f ON f.file = jf.file),
words AS (
  SELECT regime, src_lang, out, split, vocab_lang, start + len(ws) AS idx, NULL AS word FROM job_lines
  UNION ALL
  SELECT regime, src_lang, out, split, vocab_lang, start + unnest(range(len(ws))), unnest(ws) FROM job_lines),
ids AS (
  SELECT w.*, CASE WHEN word IS NULL THEN 3 ELSE coalesce(v.id, 1) END AS id
  FROM words w LEFT JOIN vocab v ON v.lang = w.vocab_lang AND v.token = w.word)
SELECT regime, src_lang, out, split, CAST(idx // {_B} AS BIGINT) AS seg_no, CAST(count(*) AS BIGINT) AS n_real,
       md5(array_to_string(list_concat([2], list(id ORDER BY idx), list_transform(range({_B} - count(*)), lambda x: 0)), ',')) AS ids_md5
FROM ids GROUP BY regime, src_lang, out, split, idx // {_B}"""))
def packed_jobs(spark, sf_dir):
    """SET-2 + JOB-3: the train and valid segments of every fine-tuning job, in the ids of its model's vocabulary.
    Files are shuffled once, encoded and packed once for each vocabulary, in chunks of many segments; jobs are ranges of
    these streams."""
    m = tb.models(spark, sf_dir)
    vocab_of = F.when(F.col("kind") == "transfer", F.split_part("model_spec", F.lit("-"), F.lit(2))).otherwise(
        F.regexp_extract("model_spec", "/([^/_]+)_", 1))
    jobs = cut_lineage(_ft_plan(spark, sf_dir).withColumn("vocab_lang", vocab_of), "jobs")
    uses = (jobs.select("vocab_lang", F.explode(F.concat("train", "valid")).alias("lang")).distinct())  # files x vocabularies
    text = tb.split_files(spark, sf_dir, places=False).withColumnRenamed("file", "lang")  # a file is to `encode` what a language's corpus is
    enc = encode(text, m.vocab, "word", uses, ["lang", "doc_id", "line_no"], known_entries=m.known,
                 block=doc_block("doc_id", tb.DOCS_PER_BLOCK))
    within = "before" if "before" in enc.columns else None  # a vocabulary too large for batches is joined
    chunk_len = CHUNK_SEGMENTS * (tb.PACK_LEN - 1) + 1
    chunks = cut_lineage(pack_segments(enc, chunk_len, ["lang", "vocab_lang"], docs_per_block=tb.DOCS_PER_BLOCK,
                                       within=within, alike=["vocab_lang"], below=tb.VOCAB_SIZE).select(
        F.col("lang").alias("file"), "vocab_lang", "seg_no", "input_ids", "n_real"), "job_chunks")
    job, both = ["regime", "src_lang", "out"], None
    for split in ("train", "valid"):
        of = jobs.select(*job, "vocab_lang", split, F.concat_ws("\n", "vocab_lang", split).alias("stream"))
        # jobs with the same files and vocabulary have the same segments, which are packed once
        segs = pack_jobs(of.drop(*job).distinct(), chunks, tb.PACK_LEN, ["stream"], split, chunk_len=chunk_len).select(
            "stream", "seg_no", "n_real", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))
        rows = segs.join(F.broadcast(of.select(*job, "stream")), "stream").withColumn("split", F.lit(split))
        both = rows if both is None else both.unionByName(rows)
    return finish(both.select(*job, "split", "seg_no", "n_real", "ids_md5"))


@register("source_jobs", O.with_ctes(["tplan", "existing"], f"""
SELECT src_lang, tgt_lang, method, model, finetuned FROM (
  SELECT *, false AS finetuned FROM tplan
  UNION ALL SELECT * REPLACE (model || '_finetuned' AS model), true FROM tplan)
WHERE src_lang = '{tb.EXISTING_SRC}'"""))
def source_jobs(spark, sf_dir):
    """FLT-1: the manifest rows of one source language."""
    rows = X.for_source(tb.manifest(spark, sf_dir), tb.EXISTING_SRC)
    return finish(rows.select("src_lang", "tgt_lang", "method", "model", "finetuned"))


@register("resolve_base", O.with_ctes(["resolved"], """
SELECT regime, model, finetuned, base_model FROM resolved"""))
def resolve_base(spark, sf_dir):
    """JN-6: the base model of every manifest row and regime; a fine-tuned row
    needs its fine-tuned source base among the planned outputs of its regime."""
    available = _ft_plan(spark, sf_dir, skip_existing=False).select("regime", "out")
    r = X.resolve_base(tb.manifest(spark, sf_dir), available, REGIME_OF)
    return finish(r.select("regime", "model", "finetuned", "base_model"))


@register("evaluation_plan", O.with_ctes(["resolved"], """
SELECT DISTINCT regime, src_lang, tgt_lang, '100mb_src' AS label, base_model AS model_spec FROM resolved
UNION ALL
SELECT DISTINCT regime, src_lang, tgt_lang, '10mb_tgt' AS label, tgt_model AS model_spec FROM resolved
UNION ALL
SELECT regime, src_lang, tgt_lang, method AS label, model AS model_spec FROM resolved"""))
def evaluation_plan(spark, sf_dir):
    """SET-4 / AGG-17: evaluation cells; baselines once per (regime, pair)."""
    available = _ft_plan(spark, sf_dir, skip_existing=False).select("regime", "out")
    p = X.evaluation_plan(X.resolve_base(tb.manifest(spark, sf_dir), available, REGIME_OF))
    return finish(p.select("regime", "src_lang", "tgt_lang", "label", "model_spec"))
