"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its content (its blob).
A ledger, two Parquet tables below one shared folder, holds which (blob, rule,
rule version) triples have been scanned and what was found.  A run scans only
the blobs that lack one of the wanted rules in its present version, each once
however many paths and versions hold it, appends to the ledger, and joins the
findings back to all paths.

A rule is a pattern, the group that holds the secret, and a least length of
that group; matches are leftmost and not overlapping for each rule, and the
ones that are too short are dropped afterwards.  Spans count code points, end
exclusive: between the matches lie the parts that ``split`` gives, and the
running sum of the lengths of parts and matches gives the offsets.

Scale: equal contents are reduced to one before the shuffle, so a group of
copies costs one scan; findings are few rows.  Findings are written before the
scanned triples, so a lost run is repeated and never skipped (findings are read
distinct).

Defined results: null content is the empty blob.  Repeated rows each get their
blob's findings.  An empty table gives an empty result and leaves the ledger as
it is.  Extra columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.session import cut_lineage, scratch_path

#: Measured size up to which the findings by blob are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
SPANS = "array<struct<start: long, kind_no: int, end: long, kind: string>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules.  A run of ``least`` characters or more is what remains of
#: all leftmost runs after the short ones are dropped, so access and hex ask for it at once;
#: for assign a short value still uses up its text, so it is dropped after matching.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", least=16),
    Rule("hex", 1, r"[0-9a-f]{32,}", least=32),
)


def blob_id(content: Column) -> Column:
    """SHA-256 of the content's UTF-8 bytes (null: of the empty text)."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")), 256))


def _triple(kind: Column, version: Column) -> Column:
    return F.concat_ws("@", kind, version.cast("string"))


def _read(spark, path: str, schema: str) -> DataFrame | None:
    """A table of the ledger, or None where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(schema).parquet(path)


def scanned_pairs(spark, ledger: str) -> DataFrame | None:
    return _read(spark, f"{ledger}/scanned", "blob binary, kind string, version int")


def unseen_blobs(versions: DataFrame, rules: Sequence[Rule], ledger: str) -> DataFrame:
    """``blob, content, todo``: each distinct blob that lacks a wanted rule, with
    the names (kind@version) of the rules it lacks."""
    wanted = F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules))
    blobs = versions.dropDuplicates(["blob"])
    seen = scanned_pairs(versions.sparkSession, ledger)
    if seen is None:
        return blobs.withColumn("todo", wanted)
    done = seen.groupBy("blob").agg(F.collect_set(_triple(F.col("kind"), F.col("version"))).alias("done"))
    return (blobs.join(done, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0).drop("done"))


def find_spans(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob, kind, version, start, end`` of every match that is long enough."""
    content = F.coalesce("content", F.lit(""))
    tried = []
    for r in rules:
        matches = F.regexp_extract_all(content, F.lit(r.pattern), F.lit(0))
        wanted = F.array_contains("todo", f"{r.kind}@{r.version}") & content.rlike(r.pattern)
        parts = F.arrays_zip(
            F.split(content, r.pattern, -1).alias("before"), matches.alias("match"),
            (F.regexp_extract_all(content, F.lit(r.pattern), F.lit(r.group)) if r.group else matches)
            .alias("secret"))
        sizes = F.transform(parts, lambda x: F.struct(
            F.length(x["before"]).alias("before"), F.length(x["match"]).alias("match"),
            F.length(x["secret"]).alias("secret")))
        tried.append(F.when(wanted, F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
            F.lit(r.least).alias("least"), sizes.alias("sizes"))))
    hits = (blobs.select("blob", F.filter(F.array(*tried), lambda x: x.isNotNull()).alias("hits"))
            .where(F.size("hits") > 0)
            .select("blob", F.explode("hits").alias("hit"))
            .select("blob", "hit.kind", "hit.version", "hit.least", F.posexplode("hit.sizes").alias("i", "x"))
            .where(F.col("x.match").isNotNull()))
    order = Window.partitionBy("blob", "kind", "version").orderBy("i")
    end = F.sum(F.col("x.before").cast("long") + F.col("x.match")).over(order)
    return (hits.withColumn("end", end).where(F.col("x.secret") >= F.col("least"))
            .select("blob", "kind", "version", (F.col("end") - F.col("x.match")).alias("start"), "end"))


def update_ledger(versions: DataFrame, rules: Sequence[Rule], ledger: str) -> None:
    """Scans what the ledger lacks and appends to it."""
    todo = unseen_blobs(versions, rules, ledger)
    find_spans(todo, rules).write.mode("append").parquet(f"{ledger}/findings")
    (unseen_blobs(versions.select("blob"), rules, ledger).select("blob", F.explode("todo").alias("pair"))
     .select("blob", F.split("pair", "@").alias("p")).select("blob", F.col("p")[0].alias("kind"), F.col("p")[1].cast("int").alias("version"))
     .write.mode("append").parquet(f"{ledger}/scanned"))


def scan(docs: DataFrame, *, content: str = "text", rules: Sequence[Rule] = RULES,
         ledger: str | None = None) -> DataFrame:
    """``docs`` with ``blob`` (its content's address) and ``findings``, an array of
    (start, kind_no, end, kind) by start, then by the rules' order.

    ``ledger`` is a shared folder that is kept between runs; without one, a
    fresh ledger below ``spark.checkpoint.dir`` is used.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "secret-ledger")
    update_ledger(docs.select(blob_id(F.col(content)).alias("blob"), F.col(content).alias("content")),
                  rules, ledger)
    number = F.array_position(F.array(*(F.lit(f"{r.kind}@{r.version}") for r in rules)),
                              _triple(F.col("kind"), F.col("version")))
    found = spark.read.schema("blob binary, kind string, version int, start long, end long").parquet(
        f"{ledger}/findings").distinct().withColumn("no", number.cast("int")).where(F.col("no") > 0)
    by_blob = cut_lineage(found.groupBy(F.col("blob").alias("__blob")).agg(F.sort_array(F.collect_list(
        F.struct("start", F.col("no").alias("kind_no"), "end", "kind"))).cast(SPANS).alias("__found")),
        "secret-findings")
    size = by_blob.agg(F.count("*"), F.sum(F.size("__found"))).first()
    if 64 * size[0] + 64 * (size[1] or 0) <= BROADCAST_BYTES:
        by_blob = F.broadcast(by_blob)
    paths = docs.select(F.struct("*").alias("__doc"), blob_id(F.col(content)).alias("__key"))
    joined = paths.join(by_blob, F.col("__key") == F.col("__blob"), "left")
    own = [c for c in docs.columns if c not in ("blob", "findings")]
    return joined.select(*(F.col(f"__doc.`{c}`").alias(c) for c in own),
                         F.lower(F.hex("__key")).alias("blob"),
                         F.coalesce("__found", F.array().cast(SPANS)).alias("findings"))


def spans_text(findings: Column) -> Column:
    """``kind:start:end``, comma-joined in order."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each union of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = F.lit(2**31 - 1)
    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(
        findings, start, step,
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), rest))))
