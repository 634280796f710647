"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct five-word shingles (the whole sequence where
it has fewer words), as 64-bit hashes.  Its sketch has ``COORDINATES`` bins
filled in rounds: in round ``i`` every shingle is hashed anew to one bin and one
value, and a bin keeps the least ``(i, value)``; rounds go on until no bin is
empty, and after as many rounds as there are bins, round ``t + j`` puts all
shingles into bin ``j``, so every coordinate fills.  A coordinate of two
sketches agrees with probability equal to the sets' resemblance, and the share
that agrees is concentrated as for independent hashes.

1. Documents of equal sets form a class, and only classes go on.
2. Four coordinates make a band; classes that share a band share a bucket.  At a
   resemblance of 0.75 the chance of sharing none of the 35 bands is 2e-6.
3. Buckets are worked off by hubs, never by all pairs.  First each bucket's
   heaviest class (the one with the most company in all its buckets) is compared
   with the others of the bucket.  Verified links join classes to components; then
   the bucket's *strays*, classes outside its main component, are compared with all
   that are not yet of their component, some per bucket at a time, more in each
   round.  A class that was a hub is done in that bucket.  The bucket is finished
   when the classes not done are of one component, so every pair of different
   components that shares a bucket has been compared.  There is no cap on a bucket.
4. A comparison first looks at sizes and sketches (fewer than ``LEAST_AGREE`` equal
   coordinates is 4.5 standard deviations below 0.75), from the second round on also
   at finer sketches, at how many shingles each class shares with any other at work
   (no intersection can be larger), and only in the first bucket that two classes
   share.  What passes is verified on the full sets: ``100 * intersection >= 75 *
   union``.
5. Components are contracted: each node points to its least neighbour, pointers
   are doubled until they rest, edges are relabelled, and so on until none is left.

Scale: texts are read once for the sketches and once for the sets of classes with
company; what is shuffled are bands, and sets once a pair.  Every join below is
between plain tables (intermediate results are written below
``spark.checkpoint.dir``), so a hot bucket, hub or component is split by the
skew handling of adaptive execution; aggregates are combined before the shuffle.

Defined results: a null or wordless text has the empty set, is linked with
nothing and is its own component.  Repeated rows are one class.  A row with a
null id belongs to its component, whose id is the least id that is not null; it
is kept only if no row of the component has an id.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transvoc.llm.scratch import Scratch
from transvoc.session import cut_lineage

SHINGLE_WORDS = 5
BAND_ROWS, BANDS = 4, 35
COORDINATES = BAND_ROWS * BANDS
#: Least percentage of the union that the intersection must have.
PERCENT = 75
#: 4.5 standard deviations of the share of equal coordinates below the wanted resemblance.
LEAST_AGREE = math.floor(COORDINATES * PERCENT / 100
                         - 4.5 * math.sqrt(COORDINATES * PERCENT / 100 * (1 - PERCENT / 100)))
#: One byte of each coordinate, seven to a number (the top byte stays free, so sums don't overflow).
PACKED = 7
#: Coordinates of the finer sketch that the second and later rounds compare, and the same bound for it.
FINE = 560
LEAST_FINE = math.floor(FINE * PERCENT / 100 - 4.5 * math.sqrt(FINE * PERCENT / 100 * (1 - PERCENT / 100)))
#: Hubs of a bucket in the second round; each further round has GROWTH times as many.
HUBS, GROWTH = 64, 8
#: Rows up to which a table of up to four numbers is broadcast (24 to 32 bytes a row).
BROADCAST_ROWS = 1_000_000
WORD_CACHE = 100_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUND = mixed(np.arange(1, 2 * max(COORDINATES, FINE) + 1, dtype=np.uint64) * _MULTIPLY)


def shingle_set(text: str | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of the lower-cased text (A-Z only)."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE_WORDS)
    if not size:
        return h
    run = h[:n - size + 1].copy()
    for j in range(1, size):
        run = run * _MULTIPLY + h[j:n - size + 1 + j]
    return np.unique(mixed(run + np.uint64(size)))


def similarity_sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The ``t`` coordinates, each round number and value in one 64-bit number."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.uint64(0xFFFFFFFF)
    bins = np.full(t, empty)
    for i in range(t):
        y = mixed(items ^ _ROUND[i])
        at = ((y >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(bins, at.astype(np.intp), (y & low) | np.uint64(i << 32))
        if not (bins == empty).any():
            return bins
    for j in np.flatnonzero(bins == empty):
        bins[j] = (mixed(items ^ _ROUND[t + j]) & low).min() | np.uint64((t + int(j)) << 32)
    return bins


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mixed(key * _MULTIPLY + rows[:, j])
    return key.view(np.int64)


def packed_bytes(sketch: np.ndarray) -> np.ndarray:
    one = (mixed(sketch) >> np.uint64(56)).reshape(-1, PACKED)
    return (one << (np.arange(PACKED, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, mark, n, digest, bands, agree``: set size, digest of the set (null for the empty
    set), band keys and packed coordinates; ``mark`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, digest, bands, agree = [], [], [], []
            for body in batch.column(2):
                items = shingle_set(body.as_py(), hashes)
                n.append(len(items))
                if len(items):
                    sketch = similarity_sketch(items)
                    digest.append(xxhash.xxh3_128_digest(items.tobytes()))
                    bands.append(band_keys(sketch))
                    agree.append(packed_bytes(sketch))
                else:
                    digest.append(None)
                    bands.append(np.empty(0, np.int64))
                    agree.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(agree, pa.list_(pa.int64()))],
                names=["id", "mark", "n", "digest", "bands", "agree"])

    return (docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"),
                        F.col(text).alias("text"))
            .mapInArrow(run, "id long, mark long, n long, digest binary, bands array<long>, agree array<long>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows are few; else it is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def full_sets(docs: DataFrame, nodes: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``node, items`` (the sorted hashes as bytes) of every node, from one row that has its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            digest, items = [], []
            for body in batch.column(0):
                found = shingle_set(body.as_py(), hashes)
                d = xxhash.xxh3_128_digest(found.tobytes())
                if d not in seen:
                    seen.add(d)
                    digest.append(d)
                    items.append(found.tobytes())
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digest, pa.binary()),
                                              "items": pa.array(items, pa.binary())})

    n = nodes.count()
    wanted = nodes.select(F.col("rep").alias("r")).distinct()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.join(_small(wanted, n), F.col("id").eqNullSafe(F.col("r")), "left_semi")
    sets = rows.select("text").mapInArrow(run, "digest binary, items binary")
    return sets.join(_small(nodes.select("digest", "node"), n), "digest").select("node", "items")


def agreeing(a: Column, b: Column) -> Column:
    """How many of the packed bytes of two sketches are equal."""
    seven, high = F.lit(0x007F7F7F7F7F7F7F), F.lit(0x0080808080808080)

    def equal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        # Per byte, the high bit of (low bits + 127) | z is set unless z is zero.
        differs = ((z.bitwiseAND(seven) + seven).bitwiseOR(z)).bitwiseAND(high)
        return PACKED - F.bit_count(differs).cast("int")

    return F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda acc, x: acc + x)


def first_shared_band(a: Column, b: Column) -> Column:
    """Number of the first band in which two classes agree (-1 if in none)."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: x == y), True) - 1).cast("int")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """``node, fine``: the packed bytes of a sketch of ``FINE`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [packed_bytes(similarity_sketch(np.frombuffer(x.as_py(), np.uint64), FINE))
                    for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.list_(pa.int64()))],
                                             names=["node", "fine"])

    return sets.mapInArrow(run, "node long, fine array<long>")


def verified(pairs: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """The pairs ``a, b, ca, cb`` whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (one, two))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    hubs = tables.cut(pairs.select("a").distinct(), "hub-nodes")
    hub_sets = sets.join(_small(hubs, hubs.count()), F.col("node") == F.col("a"), "left_semi")
    return (sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")).join(_small(pairs, n), "b")
            .join(hub_sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")).hint("merge"), "a")
            .select("a", "b", "ca", "cb", "items_a", "items_b")
            .mapInArrow(run, "a long, b long, ca long, cb long"))


def shared_counts(sets: DataFrame) -> DataFrame:
    """``node, alone``: how many items of each node's set no other of ``sets`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in items])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(np.concatenate(items) if items else [], pa.int64())],
                names=["node", "item"])

    return (sets.mapInArrow(run, "node long, item long").groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("other"))
            .where("node = other").groupBy("node").agg(F.count("*").alias("alone")))


def components(edges: DataFrame, tables: Scratch) -> DataFrame | None:
    """``node, up``: for each node of ``edges`` (``u, v``) that isn't the least of its
    component, that least node; None without edges."""
    edges = tables.cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                        .where("u <> v").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = tables.cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"))
                             .select("node", F.least("node", "v").alias("up")), "parents")
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = tables.cut(parent.join(above, "up").select(
                "node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        parent = parent.select("node", "up")
        moved = parent.where("node <> up").select(F.col("node").alias("old"), F.col("up").alias("new"))
        labels = relabelled(labels, moved) if labels is not None else parent.where("node <> up")
        edges = tables.cut(
            edges.join(parent.select(F.col("node").alias("u"), F.col("up").alias("pu")), "u")
            .join(parent.select(F.col("node").alias("v"), F.col("up").alias("pv")), "v")
            .select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct(), "edges")
    return labels


def relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """``labels`` (``node, up``) after the roots ``old`` have come under ``new``."""
    kept = (labels.join(moved, F.col("up") == F.col("old"), "left")
            .select("node", F.coalesce("new", "up").alias("up")))
    return kept.unionByName(moved.select(F.col("old").alias("node"), F.col("new").alias("up")))


def linked_classes(docs: DataFrame, classes: DataFrame, tables: Scratch, *, key: str, text: str) -> DataFrame:
    """``digest, rep, root`` of every class that shares a bucket; classes of one component share ``root``."""
    rows = classes.select("digest", F.posexplode("bands").alias("band", "key"))
    shared = tables.cut(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "keys")
    company = tables.cut(rows.join(_small(shared, shared.count()), "key"), "company")
    weight = tables.cut(company.groupBy("digest").agg(F.sum("size").alias("weight")), "weights")
    # Numbered by weight, so that the least node of a component or bucket is its heaviest.
    nodes = tables.cut(
        classes.join(_small(weight, weight.count()), "digest").orderBy(F.col("weight").desc(), "digest")
        .select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "n", "agree", "bands"), "nodes")
    sets = tables.cut(full_sets(docs, nodes, key=key, text=text), "sets")
    members = tables.cut(
        company.select("key", "band", "digest")
        .join(nodes.select("digest", "node", "n", "agree").hint("merge"), "digest")
        .select("key", "band", "node", "n", "agree", F.col("node").alias("comp"), F.lit(False).alias("done")),
        "members")

    labels, most = None, 0
    while True:
        open_node = F.when(~F.col("done"), F.col("comp"))
        keys = tables.cut(
            members.groupBy("key").agg(F.min(open_node).alias("main"), F.max(open_node).alias("other"),
                                       F.min("node").alias("top"))
            .where("main <> other").drop("other"), "open")
        n_keys = keys.count()
        if not n_keys:
            break
        at_work = members.join(_small(keys, n_keys), "key")
        if most == HUBS:
            at_work = tables.cut(with_details(at_work, nodes, sets, tables), "at-work")
        if most:
            order = Window.partitionBy("key").orderBy("node")
            hubs = (at_work.where("not done and comp <> main")
                    .withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place"))
        else:
            hubs = at_work.where("node = top")
        hubs = hubs.drop("main", "top", "band", "done")
        hubs = tables.cut(hubs.withColumnsRenamed({c: f"hub_{c}" for c in hubs.columns if c != "key"}), "hubs")
        near = ((F.col("comp") != F.col("hub_comp"))
                & (100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")))
        if most:
            common = F.least("common", "hub_common")
            near = (near & (100 * common >= PERCENT * (F.col("n") + F.col("hub_n") - common))
                    & (first_shared_band(F.col("bands"), F.col("hub_bands")) == F.col("band")))
        near = near & (agreeing(F.col("agree"), F.col("hub_agree")) >= LEAST_AGREE)
        if most:
            near = near & (agreeing(F.col("fine"), F.col("hub_fine")) >= LEAST_FINE)
        met = at_work.withColumnRenamed("key", "k").join(hubs.hint("merge"), (F.col("k") == F.col("key")) & near)
        first = F.col("node") < F.col("hub_node")
        pairs = tables.cut(met.select(
            F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b"),
            F.when(first, F.col("comp")).otherwise(F.col("hub_comp")).alias("ca"),
            F.when(first, F.col("hub_comp")).otherwise(F.col("comp")).alias("cb")).distinct(), "pairs")
        moved = None
        if not pairs.isEmpty():
            links = verified(pairs, sets, tables)
            moved = components(links.select(F.col("ca").alias("u"), F.col("cb").alias("v")), tables)
        after = (at_work.drop("main", "top")
                 .join(hubs.select("key", F.col("hub_node").alias("node"), F.lit(True).alias("now")),
                       ["key", "node"], "left")
                 .withColumn("done", F.col("done") | F.col("now").isNotNull()).drop("now"))
        if moved is not None:
            step = tables.cut(moved.select(F.col("node").alias("old"), F.col("up").alias("new")), "moved")
            after = (after.join(_small(step, step.count()), F.col("comp") == F.col("old"), "left")
                     .withColumn("comp", F.coalesce("new", "comp")).drop("old", "new"))
            labels = tables.cut(relabelled(labels, step) if labels is not None
                                else step.select(F.col("old").alias("node"), F.col("new").alias("up")), "labels")
        members = tables.cut(after, "members")
        most = most * GROWTH or HUBS
    if labels is None:
        return nodes.select("digest", "rep", F.col("node").alias("root"))
    return (nodes.select("digest", "rep", "node").join(labels, "node", "left")
            .select("digest", "rep", F.coalesce("up", "node").alias("root")))


def with_details(at_work: DataFrame, nodes: DataFrame, sets: DataFrame, tables: Scratch) -> DataFrame:
    """``at_work`` with what the later rounds compare besides: ``common`` (items that
    another class at work has too, so no intersection is larger), all ``bands`` (a
    pair is compared in its first common bucket alone) and the ``fine`` sketch."""
    busy = tables.cut(at_work.select("node").distinct(), "busy")
    n = busy.count()
    own = tables.cut(sets.join(_small(busy, n), "node", "left_semi"), "busy-sets")
    details = tables.cut(
        fine_sketches(own).join(shared_counts(own), "node", "left")
        .join(nodes.select("node", "bands", "n"), "node")
        .select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"), "bands", "fine"), "details")
    return at_work.join(details.hint("merge"), "node")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id (as ``key``), ``mark`` (hash of its text), ``n_shingles``,
    ``component_id`` and ``kept``."""
    tables = Scratch(docs.sparkSession, "near")
    sketched = tables.cut(sketches(docs, key=key, text=text), "sketches")
    classes = tables.cut(
        sketched.where("n > 0").groupBy("digest").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.first("agree").alias("agree")), "classes")
    linked = tables.cut(linked_classes(docs, classes, tables, key=key, text=text), "linked")
    ids = tables.cut(linked.groupBy("root").agg(F.min("rep").alias("least")), "ids")
    of_class = cut_lineage(
        classes.select("digest", "rep")
        .join(linked.join(ids, "root").select("digest", "least"), "digest", "left")
        .select(F.col("digest").alias("class"), F.coalesce("least", "rep").alias("component")), "near-of-class")
    found = cut_lineage(sketched.select("id", "mark", "n", "digest"), "near-rows")
    tables.clear()
    joined = found.join(of_class, F.col("digest") == F.col("class"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(key), "mark", F.col("n").alias("n_shingles"),
                         component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component (all columns, in place)."""
    verdicts = cut_lineage(near_duplicates(docs, key=key, text=text), "near-verdicts")
    rows = docs.withColumns({"__id": F.col(key).cast("long"), "__mark": F.xxhash64(text)})
    dropped = cut_lineage(verdicts.where(~F.col("kept")).select(key, "mark").distinct()
                          .withColumnsRenamed({key: "__d", "mark": "__m"}), "near-dropped")
    match = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__mark") == F.col("__m"))
    left = rows.join(_small(dropped, dropped.count()), match, "left_anti")
    # Rows that are repeated as a whole are all kept so far; of these one stays.
    repeated = cut_lineage(verdicts.where("kept").groupBy(key, "mark").count().where("count > 1")
                           .select(F.col(key).alias("__d"), F.col("mark").alias("__m")), "near-repeated")
    n = repeated.count()
    if n:
        once = left.join(_small(repeated, n), match, "left_semi").dropDuplicates(["__id", "__mark"])
        left = left.join(_small(repeated, n), match, "left_anti").unionByName(once)
    return left.drop("__id", "__mark")
