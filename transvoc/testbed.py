"""Relations derived from the driver's test tables (``documents``, ``benchmark``,
``embeddings``) that feed the registered queries.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame; all of
them scale with the input tables.  The parameters below are the workload's
fixed values; they are mirrored in :mod:`transvoc.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transvoc.functions.text import py_strip
from transvoc.operators.lm import train_lm
from transvoc.operators.tokenize import encode_long
from transvoc.operators.sampling import DEFAULT_PREMIUMS, premiums
from transvoc.operators.vocab import (N_RESERVED, build_vocab, counted_piece_vocab, counted_vocab, counted_words,
                                      piece_vocab)
from transvoc.session import cut_lineage, scratch_path, table_path
from transvoc.sources.tables import read_parquet

# Fixed values of the workload.
VOCAB_K = 2000              # words per language vocabulary
VOCAB_SIZE = VOCAB_K + N_RESERVED
ALPHA = 0.1                 # add-alpha smoothing of the bigram model
MAX_SEQ_LEN = 512           # model context, prepended id included
MCQ_MAX_LEN = 512
MIN_PAIR_MAX_LEN = MAX_SEQ_LEN
TRAIN_BYTES = 100_000
VALID_BYTES = 10_000
PACK_LEN = 128
DOCS_PER_BLOCK = 64
DOCS_PER_FILE = 4096        # document ids in a written training file
DEVTEST_MOD = 9             # doc_id % 10 == 9 is held out
TRAIN_SHARE, VALID_SHARE = 0.6, 0.1   # budgets that grow with the corpus
GATE = 0.95                 # unknown share of the report's gates: a text of another language has 0.85 to 0.99


# tables whose rows carry heavy per-row work, and the key that spreads them
BALANCE_KEYS = {"documents": "doc_id", "benchmark": "item_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, table_path(sf_dir, name), BALANCE_KEYS.get(name))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(lang, doc_id, line_no, line)``: documents split on ``\\n``, stripped."""
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return docs.select("lang", "doc_id",
                       F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")) \
        .select("lang", "doc_id", "line_no", py_strip("raw").alias("line"))


def pool(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).filter(F.col("doc_id") % 10 != DEVTEST_MOD)


def devtest(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).filter(F.col("doc_id") % 10 == DEVTEST_MOD)


def premium(spark, sf_dir=None) -> DataFrame:
    return premiums(spark, DEFAULT_PREMIUMS)


def vocab(spark, sf_dir) -> DataFrame:
    return build_vocab(pool(spark, sf_dir), VOCAB_K)


def pieces(spark, sf_dir, voc: DataFrame | None = None) -> DataFrame:
    voc = vocab(spark, sf_dir) if voc is None else voc
    return piece_vocab(voc, pool(spark, sf_dir))


def lm(spark, sf_dir, voc: DataFrame | None = None) -> DataFrame:
    """Bigram counts of every language's pool under its own vocabulary."""
    # Two passes over the pool (counts, then ids): the id-pair aggregation
    # collapses rare words into the unknown id and stays bounded by V^2 per
    # language, whereas word bigrams barely aggregate on diverse text.
    voc = vocab(spark, sf_dir) if voc is None else voc
    rows = encode_long(pool(spark, sf_dir), voc, "same", keys=["lang"],
                       known_entries=voc.count())
    return train_lm(rows)


class Models:
    """The model artifacts of one query - vocabulary, piece vocabulary and
    bigram counts - each built once and cut from its lineage with a reliable
    checkpoint (shared ``spark.checkpoint.dir``), so every later reference
    scans the written table instead of re-running a corpus pass."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark, self.sf_dir, self.materialize = spark, sf_dir, materialize
        self._cache: dict[str, DataFrame] = {}

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            df = build()
            self._cache[name] = cut_lineage(df, name) if self.materialize else df
        return self._cache[name]

    @property
    def info(self) -> DataFrame:
        """``(vocab_lang, V)``: one row per language, collected once (bounded
        metadata) and used as a local relation, so no later job recomputes it."""
        if "info" not in self._cache:
            from transvoc.operators.metrics import vocab_sizes
            rows = vocab_sizes(self.vocab).collect()
            self._known = int(sum(r["V"] for r in rows))
            self._cache["info"] = self.spark.createDataFrame(
                [(r["vocab_lang"], float(r["V"])) for r in rows], "vocab_lang string, V double")
        return self._cache["info"]

    @property
    def known(self) -> int:
        """Counted entries of all vocabularies (what a broadcast of them would hold)."""
        _ = self.info
        return self._known

    @property
    def ctx(self) -> DataFrame:
        from transvoc.operators.lm import context_counts
        return self._keep("ctx", lambda: context_counts(self.lm))

    @property
    def pool_words(self) -> DataFrame:
        """``(lang, token, n)`` of the pool: counted once for both vocabularies."""
        return self._keep("pool_words", lambda: counted_words(pool(self.spark, self.sf_dir)))

    @property
    def vocab(self) -> DataFrame:
        return self._keep("vocab", lambda: counted_vocab(self.pool_words, VOCAB_K))

    @property
    def lm(self) -> DataFrame:
        return self._keep("lm", lambda: lm(self.spark, self.sf_dir, self.vocab))

    @property
    def pieces(self) -> DataFrame:
        return self._keep("pieces", lambda: counted_piece_vocab(self.vocab, self.pool_words))


def mcq(spark, sf_dir) -> DataFrame:
    """Multiple-choice items from ``benchmark``, whole texts: passage = the first
    two thirds of an item's characters, question = the rest, answer j = the text
    of item ``(i + 3(j-1) + 1) mod N``; correct = ``1 + i mod 4``; newlines -> spaces."""
    b = read(spark, sf_dir, "benchmark").select(
        "item_id", F.regexp_replace("text", "\n", " ").alias("text"))
    n = b.agg(F.count(F.lit(1)).alias("N"))
    items = b.crossJoin(F.broadcast(n))  # one-row scalar
    opts = items.select("item_id", "N", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j"))
    opts = opts.withColumn("src_id", F.pmod(F.col("item_id") + 3 * (F.col("j") - 1) + 1, F.col("N")))
    opts = opts.join(b.select(F.col("item_id").alias("src_id"), F.col("text").alias("answer")), "src_id")
    grouped = opts.groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "answer"))),
                    lambda s: s["answer"]).alias("answers"))
    cut = F.expr("2 * length(text) div 3").cast("int")
    base = b.select("item_id",
                    F.substring("text", F.lit(1), cut).alias("passage"),
                    F.substring("text", cut + 1, F.length("text")).alias("question"),
                    (F.lit(1) + F.pmod("item_id", F.lit(4))).cast("int").alias("correct"))
    return base.join(grouped, "item_id")


def min_pairs(spark, sf_dir) -> DataFrame:
    """Every non-blank devtest line; the wrong sentence reverses the words."""
    d = devtest(spark, sf_dir).filter(F.col("line") != "")
    return d.select(
        "lang", "doc_id", "line_no", F.col("line").alias("sen"),
        F.array_join(F.reverse(F.split("line", " ", -1)), " ").alias("wrong_sen"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(lang, doc_id, line_no, raw)``: document lines before stripping."""
    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return docs.select("lang", "doc_id",
                       F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-budget train/valid split of every language's lines."""
    from transvoc.operators.sampling import byte_budget_split
    return byte_budget_split(lines(spark, sf_dir), premium(spark), TRAIN_BYTES, VALID_BYTES,
                             docs_per_block=DOCS_PER_BLOCK)


def sampled_share(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """The same split with budgets that are shares of each language's bytes, for
    the queries whose work is to grow with the corpus; without ``places`` no ``before``."""
    from transvoc.operators.sampling import byte_budget_split
    rows = lines(spark, sf_dir)
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("line")).cast("double").alias("factor"))
    return byte_budget_split(rows, sizes, TRAIN_SHARE, VALID_SHARE, docs_per_block=DOCS_PER_BLOCK, places=places)


# ---- experiment plan relations (all bounded by the number of languages)
DATADIR = "data"
MODEL_PREFIX = "models"
EXISTING_SRC = "de"         # outputs of this source language already exist ...
EXISTING_REGIME = "mono-finetuning"  # ... in this regime's folder


def languages(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("lang").distinct()


def lang_list(spark, sf_dir) -> list[str]:
    """Sorted language codes (bounded metadata; the scan reads one column)."""
    rows = languages(spark, sf_dir).collect()
    return sorted(r["lang"] for r in rows if r["lang"] is not None)


def pair_list(spark, sf_dir) -> list[str]:
    """Pivot columns ``SRC-TGT`` of every ordered language pair, sorted."""
    ls = lang_list(spark, sf_dir)
    return sorted(f"{a[:3].upper()}-{b[:3].upper()}" for a in ls for b in ls if a != b)


def mapping(spark, sf_dir) -> DataFrame:
    from transvoc.plans.experiment import language_mapping
    return language_mapping(languages(spark, sf_dir), datadir=DATADIR, model_prefix=MODEL_PREFIX)


def transfer(spark, sf_dir) -> DataFrame:
    from transvoc.plans.experiment import language_pairs, transfer_plan
    return transfer_plan(language_pairs(mapping(spark, sf_dir)))


def manifest(spark, sf_dir) -> DataFrame:
    from transvoc.plans.experiment import manifest_rows
    return manifest_rows(transfer(spark, sf_dir))


def existing(spark, sf_dir) -> DataFrame:
    """Outputs that one regime's folder holds already."""
    m = manifest(spark, sf_dir)
    return m.filter(~F.col("finetuned") & (F.col("src_lang") == EXISTING_SRC)).select(
        F.lit(EXISTING_REGIME).alias("regime"),
        F.concat(F.col("model"), F.lit("_finetuned")).alias("out"))


def split_files(spark, sf_dir, places: bool = True) -> DataFrame:
    """Sampled lines as the training files ``data/<split>/<lang>.txt``."""
    s = sampled_share(spark, sf_dir, places)
    return s.select(F.concat_ws("", F.lit(DATADIR + "/"), "split", F.lit("/"),
                                F.lower(F.concat("lang", F.lit(".txt")))).alias("file"),
                    "doc_id", "line_no", "line")


# ---- embeddings: in the donor space rank r of a vocabulary has row (r - 1) mod N of `embeddings`,
# in the source space the row half a table further on
EMB_DIMS = 64
OMP_K = 64                  # most anchors a token is rebuilt from


def emb_of_ids(spark, sf_dir, ids: DataFrame, space: str) -> DataFrame:
    """``ids`` (with an ``id`` column) joined to their vector in ``space``
    (``source`` or ``donor``)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = e.agg(F.count(F.lit(1)).alias("__n"))
    with_n = ids.crossJoin(F.broadcast(n))  # one-row scalar
    row = F.col("id") - N_RESERVED
    if space == "source":
        row = row + F.floor(F.col("__n") / 2)
    return with_n.withColumn("vec_id", F.pmod(row, F.col("__n")).cast("long")).join(e, "vec_id").drop("__n")


def transfer_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """OMP's inputs for all ordered pairs: anchors with donor and base vectors,
    missing tokens with donor vectors."""
    from transvoc.operators.transfer import pair_tokens
    v = models(spark, sf_dir).vocab
    shared, missing = pair_tokens(v)
    donor = emb_of_ids(spark, sf_dir, v.select("id").distinct(), "donor").select(
        F.col("id").alias("tgt_id"), F.col("vec").alias("donor"))
    base = emb_of_ids(spark, sf_dir, v.select("id").distinct(), "source").select(
        F.col("id").alias("src_id"), F.col("vec").alias("base"))
    keys = ["src_lang", "tgt_lang", "token", "tgt_id"]
    anchors = shared.join(donor, "tgt_id").join(base, "src_id").select(*keys, "donor", "base")
    return anchors, missing.join(donor, "tgt_id").select(*keys, "donor")


def lm_all(spark, sf_dir) -> DataFrame:
    """``(vocab_lang, lang, prev, tok, n)``: bigram counts of every language's pool under every vocabulary."""
    from transvoc.operators.transferred import text_counts
    m = models(spark, sf_dir)
    return text_counts(pool(spark, sf_dir), m.vocab, m.known, m.info)


def weights(spark, sf_dir) -> DataFrame:
    """What the tokens of every transferred model are made of: all pieces, up to ``OMP_K`` anchors."""
    from transvoc.operators.transfer import omp
    from transvoc.operators.transferred import transferred_weights
    m = models(spark, sf_dir)
    anchors, missing = transfer_inputs(spark, sf_dir)
    return transferred_weights(m.vocab, m.pieces, omp(missing, anchors, OMP_K))


def pair_matrix(spark, sf_dir) -> DataFrame:
    """The metric matrix of every ordered pair: ``regime, src_lang, tgt_lang, label`` and the 13 metrics."""
    from transvoc.functions.text import is_blank
    from transvoc.operators import transferred as TM
    from transvoc.operators.metrics import bytes_per_token
    from transvoc.operators.report import METRICS, with_pair_sums
    m, dev = models(spark, sf_dir), devtest(spark, sf_dir)
    plan = TM.model_plan(m.info.select(F.col("vocab_lang").alias("lang")))
    labels = cut_lineage(TM.counted_lines(dev.where(~is_blank("line")), m.vocab, MAX_SEQ_LEN, m.known, m.info), "labels")
    seen = cut_lineage(TM.seen_bigrams(labels), "seen")
    heavy = cut_lineage(TM.commonest(seen), "heavy")
    need = seen.select("vocab_lang", "prev_id", "token_id").distinct()
    counts, contexts = TM.part_counts(cut_lineage(weights(spark, sf_dir), "weights"),
                                      cut_lineage(lm_all(spark, sf_dir), "lm_all"), need)
    losses = cut_lineage(TM.model_losses(seen.drop("lines"), plan, counts, contexts, m.info, ALPHA), "losses")
    per_model = TM.model_metrics(TM.score_lines(labels, losses, heavy, MIN_PAIR_MAX_LEN))
    cells = TM.pair_cells(plan, cut_lineage(per_model, "per_model"), bytes_per_token(dev, m.pieces, info=m.info))
    return with_pair_sums(cells).select("regime", "src_lang", "tgt_lang", "label", *METRICS)


def written_matrix(spark, sf_dir) -> DataFrame:
    """:func:`pair_matrix`, written once for the query that reads it; as with all model artifacts, nothing is kept for
    another query of the session, whose cost would then follow from what ran before it."""
    return cut_lineage(pair_matrix(spark, sf_dir), "pair_matrix")


#: Labels of the metrics file that no run evaluates.
NOT_EVALUATED = ("10mb_src", "100mb_tgt")


def metrics(spark, sf_dir) -> DataFrame:
    """``metrics_wide``, what the report queries read: the metric matrix, and empty cells for the
    labels that are never evaluated."""
    from transvoc.operators.report import METRICS
    cells = written_matrix(spark, sf_dir).withColumnRenamed("label", "method")
    never = (cells.select("regime", "src_lang", "tgt_lang").distinct()
             .select("*", F.explode(F.array(*map(F.lit, NOT_EVALUATED))).alias("method"))
             .withColumns({c: F.lit(None).cast("double") for c in METRICS}))
    return cells.unionByName(never)


# ---- one Models per registered-query invocation (see catalog.register)
_SCOPE: dict[tuple, Models] = {}


def models(spark: SparkSession, sf_dir: str) -> Models:
    key = (id(spark), sf_dir)
    if key not in _SCOPE:
        _SCOPE[key] = Models(spark, sf_dir)
    return _SCOPE[key]


def reset_scope() -> None:
    _SCOPE.clear()
