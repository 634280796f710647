"""Experiment plans as DataFrames (PRJ-1, PRJ-2, FLT-1, JN-1, JN-2, JN-5, JN-6,
SET-2..4, AGG-15, AGG-17, SRC-7, SNK-2).

Plans are metadata-sized (languages, pairs, models); the one place they meet
corpus-sized data is :func:`route_lines`.  Every table here is bounded by the
number of languages squared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Transfer methods and the evaluation labels produced per pair.
METHODS = ("fvt", "omp")
SRC_BASELINE = "100mb_src"
TGT_BASELINE = "10mb_tgt"

FINETUNE_DATA = T.StructType([T.StructField("train", T.StringType()),
                              T.StructField("valid", T.StringType())])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("src_lang", T.StringType()),
    T.StructField("tgt_lang", T.StringType()),
    T.StructField("src_model", T.StringType()),
    T.StructField("tgt_model", T.StringType()),
    T.StructField("src_finetune_data", FINETUNE_DATA),
    T.StructField("tgt_finetune_data", FINETUNE_DATA),
    T.StructField("method", T.StringType()),
    T.StructField("finetuned", T.BooleanType()),
])


def language_mapping(langs: DataFrame, source_size: str = "100MB", target_size: str = "10MB",
                     datadir: str = "data", model_prefix: str = "models") -> DataFrame:
    """PRJ-1: model names (lower-cased) and train/valid files per language."""
    lf = F.lower(F.concat(F.col("lang"), F.lit(".txt")))
    return langs.select(
        "lang",
        F.lower(F.concat_ws("", F.lit(model_prefix + "/"), "lang", F.lit("_" + source_size)))
        .alias("source"),
        F.lower(F.concat_ws("", F.lit(model_prefix + "/"), "lang", F.lit("_" + target_size)))
        .alias("target"),
        F.concat(F.lit(datadir.rstrip("/") + "/train/"), lf).alias("train"),
        F.concat(F.lit(datadir.rstrip("/") + "/valid/"), lf).alias("valid"),
    )


def model_name(src: str = "src_lang", tgt: str = "tgt_lang", method: str = "method"):
    """PRJ-2: ``src-tgt-method``."""
    return F.concat_ws("-", F.col(src), F.col(tgt), F.col(method))


def base_name(path_col, suffix_col):
    """PRJ-2: ``<last path part>_<lang>_finetuned``."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    s = F.col(suffix_col) if isinstance(suffix_col, str) else suffix_col
    return F.concat(F.element_at(F.split(p, "/"), -1), F.lit("_"), s, F.lit("_finetuned"))


def language_pairs(mapping: DataFrame) -> DataFrame:
    """JN-1: ordered pairs ``src != tgt`` - n(n-1) rows of a per-language table.

    The mapping is metadata (one row per language)
    so the theta join runs as a broadcast nested loop over it.
    """
    t = mapping.select(F.col("lang").alias("tgt_lang"), F.col("target").alias("tgt_model"),
                       F.struct(F.col("train"), F.col("valid")).alias("tgt_finetune_data"))
    s = mapping.select(F.col("lang").alias("src_lang"), F.col("source").alias("src_model"),
                       F.struct(F.col("train"), F.col("valid")).alias("src_finetune_data"))
    return t.join(F.broadcast(s), F.col("src_lang") != F.col("tgt_lang"))


def transfer_plan(pairs: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """JN-2: pair x method with the output model name; a manifest row each."""
    m = pairs.sparkSession.createDataFrame([(x,) for x in methods], "method string")
    plan = pairs.crossJoin(F.broadcast(m))  # methods: a fixed two-row dimension
    return plan.withColumn("model", model_name()).withColumn("finetuned", F.lit(False))


def manifest_rows(plan: DataFrame) -> DataFrame:
    """Manifest rows (D6) of a transfer plan, both the transferred copy and the
    fine-tuned copy (SNK-2 flips ``finetuned``; the folder gets ``_finetuned``)."""
    cols = [f.name for f in MANIFEST_SCHEMA.fields]
    base = plan.select("model", *cols)
    tuned = base.withColumn("finetuned", F.lit(True)).withColumn(
        "model", F.concat(F.col("model"), F.lit("_finetuned")))
    return base.unionByName(tuned)


def read_manifest(spark: SparkSession, path: str, layout: str = "partitioned",
                  file_name: str = "transfer_info.json") -> DataFrame:
    """SRC-7: one JSON document per model folder; folders without one simply
    do not appear.

    ``layout='partitioned'`` reads what :func:`write_manifest` writes
    (``model=<name>/part-*.json``).  ``layout='folders'`` reads
    ``<model>/<file_name>`` trees (each file is one JSON object, possibly
    pretty-printed); the model name is the parent folder of the file.
    """
    if layout == "partitioned":
        schema = T.StructType([*MANIFEST_SCHEMA.fields, T.StructField("model", T.StringType())])
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if layout != "folders":
        raise ValueError(f"unknown manifest layout {layout!r}")
    df = (spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST")
          .option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).json(path))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select(*[f.name for f in MANIFEST_SCHEMA.fields], folder.alias("model"))


def for_source(manifest: DataFrame, lang: str) -> DataFrame:
    """FLT-1: manifest rows of one source language."""
    return manifest.filter(F.col("src_lang") == lang)


def tuned_manifests(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """SNK-2: the manifest of every job's output: that of the model it starts from with ``finetuned`` set, only where
    that model has one (a base model has none).  ``found`` is a scanned manifest tree."""
    fields = [f.name for f in MANIFEST_SCHEMA.fields if f.name != "finetuned"]
    start = found.select(F.col("model").alias("model_spec"), *(F.col(c).alias(f"m_{c}") for c in fields))
    return jobs.select("regime", "out", "model_spec").join(start, "model_spec").select(
        F.concat_ws("/", "regime", "out").alias("model"), *(F.col(f"m_{c}").alias(c) for c in fields),
        F.lit(True).alias("finetuned"))


def finetune_plan(manifest: DataFrame, existing: DataFrame | None = None,
                  overwrite: bool = False,
                  regimes: Sequence[tuple[str, bool]] = (("mono-finetuning", False),
                                                         ("mixed-finetuning", True))) -> DataFrame:
    """SET-3 / AGG-15 / JN-5 / FLT-1: fine-tuning jobs for every source
    language and regime.

    Jobs: the source base model once per target language, the target base
    model once per source language, and every transferred model.  Training
    files follow the routing rules (SET-2): mixed -> source then target
    (target base: target then source); mono -> target only (target base:
    *source* only).  Duplicate outputs keep the first job; outputs listed in
    ``existing`` are skipped unless ``overwrite``.
    """
    spark = manifest.sparkSession
    reg = spark.createDataFrame(list(regimes), "regime string, combine boolean")
    m = manifest.filter(~F.col("finetuned"))
    m = m.crossJoin(F.broadcast(reg))  # regimes: a fixed two-row dimension
    s_tr, t_tr = F.col("src_finetune_data.train"), F.col("tgt_finetune_data.train")
    s_va, t_va = F.col("src_finetune_data.valid"), F.col("tgt_finetune_data.valid")
    comb = F.col("combine")
    src_base = m.select(
        "regime", "src_lang", F.lit(0).alias("kind_ord"), F.lit("src_base").alias("kind"),
        "model", F.col("src_model").alias("model_spec"),
        base_name("src_model", "tgt_lang").alias("out"),
        F.when(comb, F.array(s_tr, t_tr)).otherwise(F.array(t_tr)).alias("train"),
        F.when(comb, F.array(s_va, t_va)).otherwise(F.array(t_va)).alias("valid"))
    tgt_base = m.select(
        "regime", "src_lang", F.lit(1).alias("kind_ord"), F.lit("tgt_base").alias("kind"),
        "model", F.col("tgt_model").alias("model_spec"),
        base_name("tgt_model", "src_lang").alias("out"),
        F.when(comb, F.array(t_tr, s_tr)).otherwise(F.array(s_tr)).alias("train"),
        F.when(comb, F.array(t_va, s_va)).otherwise(F.array(s_va)).alias("valid"))
    transferred = m.select(
        "regime", "src_lang", F.lit(2).alias("kind_ord"), F.lit("transfer").alias("kind"),
        "model", F.col("model").alias("model_spec"),
        F.concat(F.element_at(F.split("model", "/"), -1), F.lit("_finetuned")).alias("out"),
        F.when(comb, F.array(s_tr, t_tr)).otherwise(F.array(t_tr)).alias("train"),
        F.when(comb, F.array(s_va, t_va)).otherwise(F.array(t_va)).alias("valid"))
    jobs = src_base.unionByName(tgt_base).unionByName(transferred)
    w = Window.partitionBy("regime", "src_lang", "out").orderBy("kind_ord", "model")
    jobs = jobs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    if existing is not None and not overwrite:
        # an output exists in the folder of its own regime
        jobs = jobs.join(existing.select("regime", "out").distinct(), ["regime", "out"], "left_anti")
    return jobs


def route_lines(jobs: DataFrame, corpus: DataFrame, files: str = "train") -> DataFrame:
    """SET-2: the training lines of every job, in order.

    ``corpus`` holds ``(file, doc_id, line_no, line)`` rows; a job's file list
    is exploded with its position, so the order key is
    ``(file_ord, doc_id, line_no)``.  This replicates each corpus once per job
    that uses it, which is what training data export needs.
    """
    j = jobs.select("regime", "src_lang", "out",
                    F.posexplode(files).alias("file_ord", "file"))
    return j.join(corpus, "file")


def route_summary(jobs: DataFrame, corpus: DataFrame, files: str = "train") -> DataFrame:
    """SET-2 as volumes: the corpus is aggregated per file *before* it meets
    the (small) job table, so nothing corpus-sized is replicated."""
    per_file = corpus.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"),
        F.min("doc_id").alias("first_doc"))
    j = jobs.select("regime", "src_lang", "out",
                    F.posexplode(files).alias("file_ord", "file"))
    return j.join(F.broadcast(per_file), "file", "left")


def resolve_base(manifest: DataFrame, available: DataFrame,
                 regime_of: dict[bool, Sequence[str]]) -> DataFrame:
    """JN-6: per regime, the model a ``100mb_src`` baseline is evaluated with -
    the fine-tuned sibling in the same regime's folder if the row is fine-tuned,
    else the original source model.  ``available`` lists ``(regime, out)``; a
    missing sibling is an error that names all of them by count.

    ``regime_of`` maps ``finetuned`` to the regimes whose folder holds such rows.
    """
    spark = manifest.sparkSession
    rows = [(ft, r) for ft, rs in regime_of.items() for r in rs]
    reg = spark.createDataFrame(rows, "finetuned boolean, regime string")
    df = manifest.join(F.broadcast(reg), "finetuned").withColumn(
        "base_model",
        F.when(F.col("finetuned"), base_name("src_model", "tgt_lang")).otherwise(F.col("src_model")))
    need = df.filter("finetuned").select("regime", F.col("base_model").alias("out")).distinct()
    missing = need.join(available.select("regime", "out").distinct(), ["regime", "out"], "left_anti")
    n = missing.count()
    if n:
        shown = [f"{r['regime']}/{r['out']}" for r in missing.orderBy("regime", "out").limit(20).collect()]
        raise FileNotFoundError(
            f"fine-tuned models require fine-tuned base models; {n} missing, first: {shown}")
    return df


def evaluation_plan(resolved: DataFrame) -> DataFrame:
    """SET-4 / AGG-17: cells ``(regime, src, tgt, label, model_spec)`` of
    :func:`resolve_base` rows.

    Per (src, tgt): the source baseline (resolved base) and the target
    baseline once each, plus one cell per transferred model.
    """
    m = resolved
    src = m.select("regime", "src_lang", "tgt_lang", F.lit(SRC_BASELINE).alias("label"),
                   F.col("base_model").alias("model_spec"))
    tgt = m.select("regime", "src_lang", "tgt_lang", F.lit(TGT_BASELINE).alias("label"),
                   F.col("tgt_model").alias("model_spec"))
    tr = m.select("regime", "src_lang", "tgt_lang", F.col("method").alias("label"),
                  F.col("model").alias("model_spec"))
    baselines = src.unionByName(tgt).dropDuplicates(["regime", "src_lang", "tgt_lang", "label"])
    return baselines.unionByName(tr)
