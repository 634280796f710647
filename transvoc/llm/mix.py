"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its weight's share of the whole
mix, at most ``max_copies`` times the words it has; what a capped source leaves
is shared again by weight until no source is above its cap.

A document's expected copies are its source's target over its source's words
(times its own weight, where given).  The whole part is certain.  The rest is
an inclusion probability ``p``: each document draws ``u`` from a hash, is ranked
by the ratio of odds ``q = (u / (1 - u)) / (p / (1 - p))``, and documents are
taken in this order until the next would pass the source's target; what is left
goes to up to ``LAST_PLACES`` documents just after the cut that fit in it, and
one that passes it where that is nearer.  So a source's words come to its target
up to less than one document.

The order is never sorted as a whole.  Draws fall into buckets of some
thousands of documents; word sums by (source, bucket), pre-aggregated, show in
which bucket the target is reached, and only that one is sorted.  The plan (one
row a source: copies, cut, last place) is then applied to the rows where they
are, so texts are never shuffled.  A source that holds a third of all rows is
spread over its buckets.

Defined results: null or wordless text has size 0 and is taken with 0 words;
null ``source`` is a source of its own, last in order; a source without words
has target 0.  The draw depends on ``seed`` and the key columns alone, so
reruns agree; name the text, or a hash of it, among the keys where ids are null or
repeat.  Rows equal in all key columns share one draw and so one place in the
order.  Where the target falls inside such a group, as many of its rows are taken as
fit: the group is reduced to its distinct rows and their numbers, and copies are
counted off in order of content, so a group of any size passes through partial
aggregation; which of wholly equal rows is taken makes no difference.  Very long
texts are read whole, for their size only.  An empty table gives an empty mix.
Extra columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.session import cut_lineage

#: Sources up to which the plan is broadcast (a row has about 100 bytes); beyond, it is joined salted.
BROADCAST_SOURCES = 100_000
SALTS = 32
#: Documents in a bucket of the order, about.
BUCKET_DOCS = 4096
#: Documents after the cut that may fill what the one at the cut is too long for.
LAST_PLACES = 3


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place`` (from 0) by code point of ``source``, null last.

    Numbered inside range partitions plus the partitions' offsets, so no task
    sees all sources; the partitioned rows are written before they are counted.
    """
    dealt = cut_lineage(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()), "mix-sources")
    offsets = (dealt.groupBy("part").agg(F.count("*").alias("n"))
               .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (dealt.withColumn("row", F.row_number().over(within) - 1)
            .join(offsets.drop("n"), "part")
            .withColumn("place", F.col("row") + F.col("before")).drop("part", "row", "before"))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float,
                   max_copies: float) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``target``: ``share`` of all
    words by weight, capped at ``max_copies`` times the source, the excess
    shared again.  Each round brings one row of sums to the driver."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("place") % len(weights) + 1).cast("int"))
    table = cut_lineage(numbered_sources(sources).withColumn("weight", weight)
                        .withColumn("cap", F.col("source_size") * F.lit(float(max_copies))), "mix-weights")
    total = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = (total[0] or 0) * share
    level = wanted / total[1] if total[1] else 0.0
    capped = -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        now = table.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("full"),
                        F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if now["n"] == capped or not now["open"]:
            break
        capped, level = now["n"], (wanted - (now["full"] or 0.0)) / now["open"]
    return table.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def draw(keys: Sequence[Column], seed: int) -> Column:
    """A number in (0, 1) from a hash of the key columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def _with_plan(rows: DataFrame, plan: DataFrame, n_sources: int, key: Column) -> DataFrame:
    """``rows`` joined to their source's row of ``plan`` (null matches null)."""
    plan = plan.withColumnRenamed("source", "__plan_source")
    if n_sources <= BROADCAST_SOURCES:
        match = F.col("__source").eqNullSafe(F.col("__plan_source"))
        return rows.join(F.broadcast(plan), match).drop("__plan_source")
    spread = plan.withColumn("__plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    match = (F.col("__source").eqNullSafe(F.col("__plan_source"))
             & (F.col("__salt") == F.col("__plan_salt")))
    return salted.join(spread, match).drop("__plan_source", "__plan_salt", "__salt")


def _with_order(rows: DataFrame, max_copies: float) -> DataFrame:
    """Adds ``__whole`` copies, ``__p`` and the rank ``__q`` to rows joined to their source."""
    rate = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__copies", F.least(F.lit(float(max_copies)), F.col("__weight") * rate))
    rows = rows.withColumn("__whole", F.floor("__copies"))
    rows = rows.withColumn("__p", F.col("__copies") - F.col("__whole"))
    odds = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
    return rows.withColumn("__q", F.when(F.col("__p") > 0, odds))


def _not_in(taken: Column):
    return lambda x: ~F.array_contains(taken, x["__q"])


def _counted_off(tied: DataFrame, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of rows that share their source's cut, the first ``part`` of them drawn."""
    rows = (tied.groupBy("__source", F.sha2(F.to_json("__doc"), 256).alias("__content"))
            .agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*kept, "part"))))
    before = F.sum("n").over(Window.partitionBy("__source").orderBy("__content")) - F.col("n")
    return (rows.withColumn("__before", before)
            .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select(*kept, (F.col("__i") + F.col("__before") <= F.col("part")).alias("__drawn")))


def mix(docs: DataFrame, *, size: Column, source: str = "source", keys: Sequence[str] = ("doc_id",),
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: float = 2.0,
        weight: str | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size).

    ``weights`` go round over the sources by code point; ``weight`` names a
    column of a document's own weight (null or absent: 1).
    """
    own = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    marked = docs.select(F.struct("*").alias("__doc"), F.col(source).alias("__source"),
                         size.alias("__size"), own.alias("__weight"),
                         draw([F.col(k) for k in keys], seed).alias("__u"))
    narrow = cut_lineage(marked.drop("__doc"), "mix-sizes")

    sources = source_targets(
        narrow.groupBy(F.col("__source").alias("source"))
        .agg(F.sum("__size").alias("source_size"), F.count("*").alias("n"),
             F.sum(F.col("__size") * F.col("__weight")).alias("weighted")),
        weights, share, max_copies)
    sources = cut_lineage(
        sources.select("source", "source_size", "target", "weighted",
                       F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_DOCS)).alias("buckets")),
        "mix-targets")
    n_sources = sources.count()

    ranked = _with_order(_with_plan(narrow, sources, n_sources, F.col("__u")), max_copies)
    # Place in the order, scaled so that documents of weight 1 spread evenly over (0, 1).
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rest = rate - F.floor(rate)
    scaled = F.col("__q") * F.coalesce(F.nullif(rest / (1 - rest), F.lit(0.0)), F.lit(1.0))
    bucket = F.least(F.floor(scaled / (1 + scaled) * F.col("buckets")), F.col("buckets") - 1)
    ranked = ranked.withColumn("bucket", F.when(F.col("__q").isNotNull(), bucket))

    cells = (ranked.groupBy("__source", "bucket")
             .agg(F.sum("__size").alias("words"), F.sum(F.col("__size") * F.col("__whole")).alias("whole"),
                  F.first("target").alias("target")))
    by_source = Window.partitionBy("__source")
    reached = F.sum("words").over(by_source.orderBy("bucket"))
    cells = (cells.withColumn("need", F.col("target") - F.sum("whole").over(by_source))
             .where(F.col("bucket").isNotNull()).withColumn("reached", reached))
    cut = (cells.where(F.col("reached") > F.col("need")).groupBy("__source")
           .agg(F.min_by(F.struct("bucket", (F.col("need") - F.col("reached") + F.col("words")).alias("left")),
                         "bucket").alias("cut"))
           .select(F.col("__source").alias("source"), F.col("cut.bucket").alias("cut_bucket"), "cut.left"))
    cut = cut_lineage(cut, "mix-cuts")

    edge = (_with_plan(ranked, cut, n_sources, F.col("__u"))
            .where(F.col("bucket") == F.col("cut_bucket"))
            .groupBy("__source", "left", "__q")
            .agg(F.sum("__size").alias("words"), F.count("*").alias("n"),
                 F.min("__size").alias("each"), F.max("__size").alias("longest")))
    edge = edge.withColumn("sum", F.sum("words").over(by_source.orderBy("__q")))
    inside = F.col("sum") <= F.col("left")
    # Rows that share a draw and do not all fit: as many as do.
    split = (~inside & (F.col("sum") - F.col("words") < F.col("left"))
             & (F.col("n") > 1) & (F.col("each") == F.col("longest")))
    edge = edge.withColumn("part", F.when(split, F.floor(
        (F.col("left") - F.col("sum") + F.col("words")) / F.col("each"))))
    cuts = edge.groupBy("__source").agg(
        F.coalesce(F.max(F.when(inside, F.col("__q"))), F.lit(-1.0)).alias("cut_q"),
        (F.first("left") - F.coalesce(F.max(F.when(inside, F.col("sum"))), F.lit(0))
         - F.coalesce(F.max(F.col("part") * F.col("each")), F.lit(0))).alias("gap"),
        F.max(F.when(split, F.col("__q"))).alias("part_q"), F.max("part").alias("part"),
        F.collect_list(F.when(~inside & ~split, F.struct("words", "__q"))).alias("others"))
    # The last places: up to LAST_PLACES that fit below the gap, the largest first, and perhaps
    # one that passes it, whichever of these ends nearest to the target.
    cuts = cuts.withColumn("taken", F.array().cast("array<double>"))
    ends = []
    for i in range(LAST_PLACES + 1):
        left = F.filter("others", _not_in(F.col("taken")))
        above = F.array_min(F.transform(F.filter(left, lambda x: x["words"] > F.col("gap")), lambda x: F.struct(
            (x["words"] - F.col("gap")).alias("miss"), F.concat("taken", F.array(x["__q"])).alias("taken"))))
        fit = F.array_max(F.filter(left, lambda x: (x["words"] <= F.col("gap")) & (x["words"] > 0)))
        below = F.struct(F.col("gap").cast("double").alias("miss"), "taken")
        cuts = cuts.withColumns({f"below{i}": below, f"above{i}": above, "fit": fit})
        ends += [f"below{i}", f"above{i}"]
        cuts = cuts.withColumns({
            "taken": F.when(F.col("fit").isNull(), F.col("taken"))
            .otherwise(F.concat("taken", F.array(F.col("fit.__q")))),
            "gap": F.col("gap") - F.coalesce("fit.words", F.lit(0))})
    cuts = cuts.select("__source", "cut_q", "part_q", "part", F.least(*ends)["taken"].alias("last"))
    plan = (sources.join(cut.withColumnRenamed("source", "c_source"),
                         F.col("source").eqNullSafe(F.col("c_source")), "left")
            .join(cuts.withColumnRenamed("__source", "e_source"),
                  F.col("source").eqNullSafe(F.col("e_source")), "left")
            .select("source", "source_size", "target", "weighted", "buckets", "cut_bucket",
                    "cut_q", "last", "part_q", "part"))
    plan = cut_lineage(plan, "mix-plan")

    placed = _with_order(_with_plan(marked, plan, n_sources, F.col("__u")), max_copies)
    placed = placed.withColumn("bucket", F.when(F.col("__q").isNotNull(), bucket))
    drawn = F.col("__q").isNotNull() & (
        F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket"))
        | ((F.col("bucket") == F.col("cut_bucket"))
           & ((F.col("__q") <= F.col("cut_q"))
              | F.array_contains("last", F.col("__q")))))
    placed = placed.withColumn("__drawn", drawn)
    if not plan.where("part > 0").isEmpty():
        parted = F.coalesce((F.col("bucket") == F.col("cut_bucket")) & (F.col("__q") == F.col("part_q"))
                            & (F.col("part") > 0), F.lit(False))
        kept = ["__doc", "__size", "source_size", "target", "__whole"]
        placed = (placed.where(~parted).select(*kept, "__drawn")
                  .unionByName(_counted_off(placed.where(parted), kept)))
    copies = F.col("__whole") + F.when(F.col("__drawn"), 1).otherwise(0)
    added = {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"),
             "copies": copies.cast("int"), "taken": (copies * F.col("__size")).cast("long")}
    return placed.select(*(F.col(f"__doc.`{c}`").alias(c) for c in docs.columns if c not in added),
                         *(c.alias(n) for n, c in added.items()))
