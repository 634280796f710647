"""Segment packing against its definition."""

import itertools
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from transvoc.operators.packing import pack_segments

PRE, SEP, PAD = 2, 3, 0


def defined_segments(lines, L, reference_mask=False):
    """Pieces of the stream between multiples of L - 1; only the last may be short."""
    stream = list(itertools.chain.from_iterable([*ids, SEP] for ids in lines))
    pieces = [stream[k * (L - 1):(k + 1) * (L - 1)] for k in range(math.ceil(len(stream) / (L - 1)))]
    out = []
    for piece in pieces:
        real = 1 + len(piece)
        marked = real - (1 if reference_mask and real < L else 0)
        out.append(((PRE, *piece, *itertools.repeat(PAD, L - real)),
                    tuple(int(place < marked) for place in range(L))))
    return [(list(a), list(b)) for a, b in out]


def run(spark, lines, L, reference_mask=False, block=2):
    rows = [("c", k, 0, ids) for k, ids in enumerate(lines)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, ids array<int>")
    segs = pack_segments(df, L, ["lang"], reference_mask=reference_mask, docs_per_block=block)
    return [(list(r["input_ids"]), list(r["attention_mask"]))
            for r in sorted(segs.collect(), key=lambda r: r["seg_no"])]


def test_exact_fit_not_padded(spark):
    got = run(spark, [[11, 12, 13, 14, 15]], 4)   # 5 ids + separator = 6 tokens
    assert got == [([2, 11, 12, 13], [1, 1, 1, 1]), ([2, 14, 15, 3], [1, 1, 1, 1])]


def test_padded_last_segment_and_reference_mask(spark):
    lines = [[11, 12, 13, 14, 15, 16]]              # 7 stream tokens
    got = run(spark, lines, 4)
    assert got[-1] == ([2, 3, 0, 0], [1, 1, 0, 0])
    ref = run(spark, lines, 4, reference_mask=True)
    assert ref[-1] == ([2, 3, 0, 0], [1, 0, 0, 0])


def test_one_token_missing(spark):
    got = run(spark, [[11, 12, 13, 14]], 4)         # 5 stream tokens
    assert got[1] == ([2, 14, 3, 0], [1, 1, 1, 0])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(4, 50), max_size=7), min_size=1, max_size=12),
       st.integers(2, 9))
def test_matches_definition(spark, lines, L):
    assert run(spark, lines, L) == defined_segments(lines, L)
    assert run(spark, lines, L, reference_mask=True) == defined_segments(lines, L, True)
    # concatenating the unpadded bodies gives the stream back
    body = [t for ids, mask in run(spark, lines, L) for t, m in zip(ids[1:], mask[1:]) if m]
    assert body == [t for ids in lines for t in (*ids, SEP)]


def test_jobs_are_their_files_one_after_the_other(spark):
    import random

    from transvoc.operators.packing import pack_jobs
    r = random.Random(4)
    files = {f"f{i}": [[r.randint(4, 9) for _ in range(r.randint(0, 7))] for _ in range(n)]
             for i, n in enumerate((9, 1, 14, 4))}
    enc = spark.createDataFrame(
        [(f, v, 0, i, [x * 10 * (v == "b") + x for x in ids]) for f, rows in files.items() for v in "ab"
         for i, ids in enumerate(rows)], "file string, vocab_lang string, doc_id long, line_no int, ids array<int>")
    L = 6
    chunks = pack_segments(enc, L, ["file", "vocab_lang"])
    jobs = [("j1", "a", ["f0"]), ("j2", "b", ["f0", "f2"]), ("j3", "a", ["f2", "f1", "f3"]), ("j4", "b", ["f1", "f0"])]
    got = {}
    out = pack_jobs(spark.createDataFrame(jobs, "job string, vocab_lang string, train array<string>"), chunks, L, ["job"])
    for row in out.collect():
        got.setdefault(row.job, {})[row.seg_no] = (list(row.input_ids), row.n_real)
    for job, v, names in jobs:
        stream = [t for f in names for ids in files[f] for t in [*(x * 10 * (v == "b") + x for x in ids), 3]]
        cut = [stream[i:i + L - 1] for i in range(0, len(stream), L - 1)]
        assert got[job] == {i: ([2, *c, *[0] * (L - 1 - len(c))], len(c)) for i, c in enumerate(cut)}


def test_ranges_of_jobs_are_not_broadcast(spark, tmp_dir):
    from transvoc.operators.packing import pack_jobs

    spark.sql("SELECT 'j' AS job, 'v' AS vocab_lang, array('f', 'g') AS train").write.parquet(f"{tmp_dir}/jobs")
    (spark.range(40).selectExpr("if(id < 30, 'f', 'g') AS file", "'v' AS vocab_lang", "if(id < 30, id, id - 30) AS seg_no",
                                "array(2, cast(id AS int), 3) AS input_ids", "2L AS n_real").write.parquet(f"{tmp_dir}/chunks"))
    jobs, chunks = (spark.read.parquet(f"{tmp_dir}/{x}") for x in ("jobs", "chunks"))
    segs = pack_jobs(jobs, chunks, 3, ["job"])
    plan = segs._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "SortMergeJoin" in line and "chunk" in line]
    assert [r.input_ids[1] for r in segs.orderBy("seg_no").collect()] == list(range(40))


def test_ids_are_made_once_for_lengths_and_places(spark):
    from transvoc.operators.packing import token_offsets
    enc = spark.createDataFrame([("c", k, 0, [7] * k) for k in range(9)], "lang string, doc_id long, line_no int, ids array<int>")
    placed = token_offsets(enc, ["lang"], ["doc_id", "line_no"], docs_per_block=2)
    assert "ExistingRDD" not in placed._jdf.queryExecution().executedPlan().toString()  # read from where they were written
    assert [r["start"] for r in placed.orderBy("doc_id").collect()] == [sum(range(1, k + 1)) for k in range(9)]


def test_jobs_of_long_chunks_are_their_files_one_after_the_other(spark):
    """Chunks of several segments: whole ones are cut from one chunk, others put together from pieces of two or more."""
    import random

    from transvoc.operators.packing import pack_jobs
    r = random.Random(11)
    files = {f"f{i}": [[r.randint(4, 9) for _ in range(r.randint(0, 7))] for _ in range(n)]
             for i, n in enumerate((40, 1, 27, 2, 1))}
    enc = spark.createDataFrame(
        [(f, v, i, 0, [x * 10 * (v == "b") + x for x in ids]) for f, rows in files.items() for v in "ab"
         for i, ids in enumerate(rows)], "file string, vocab_lang string, doc_id long, line_no int, ids array<int>")
    jobs = [("j1", "a", ["f0"]), ("j2", "b", ["f0", "f2"]), ("j3", "a", ["f1", "f4", "f3", "f2", "f1"]), ("j4", "b", ["f2", "f1", "f0"])]
    table = spark.createDataFrame(jobs, "job string, vocab_lang string, train array<string>")
    for L, held in ((6, 4), (3, 5), (30, 2)):
        chunk_len = held * (L - 1) + 1
        got = {}
        for row in pack_jobs(table, pack_segments(enc, chunk_len, ["file", "vocab_lang"]), L, ["job"], chunk_len=chunk_len).collect():
            assert row.seg_no not in got.setdefault(row.job, {})
            got[row.job][row.seg_no] = (list(row.input_ids), row.n_real)
        for job, v, names in jobs:
            stream = [t for f in names for ids in files[f] for t in [*(x * 10 * (v == "b") + x for x in ids), 3]]
            cut = [stream[i:i + L - 1] for i in range(0, len(stream), L - 1)]
            assert got[job] == {i: ([2, *c, *[0] * (L - 1 - len(c))], len(c)) for i, c in enumerate(cut)}


def test_only_pieces_at_the_ends_of_chunks_are_listed(spark):
    """A file of 4,000 tokens from place 3 on has 400 segments of 10; pieces are listed for those that a chunk of 500 cuts."""
    from transvoc.operators.packing import job_pieces
    placed = spark.createDataFrame([("j", "f", 3, 4000)], "job string, file string, base long, n long")
    got = [tuple(r) for r in job_pieces(placed, 10, 500).select("chunk", "seg_no", "at", "first", "n").orderBy("at").collect()]
    want = [p for c in range(8) for p in ((c, 50 * c, 500 * c + 3, 0, 7), (c, 50 * (c + 1), 500 * (c + 1), 497, 3))]
    assert got == want


def test_segments_within_a_chunk_are_not_shuffled(spark, tmp_dir):
    from transvoc.operators.packing import pack_jobs

    (spark.range(50).selectExpr("'f' AS file", "'v' AS vocab_lang", "id AS seg_no", "40L AS n_real",
                                "concat(array(2), transform(sequence(1, 40), x -> cast(id * 40 + x AS int))) AS input_ids")
     .write.parquet(f"{tmp_dir}/chunks"))
    jobs = spark.sql("SELECT 'j' AS job, 'v' AS vocab_lang, array('f') AS train")
    segs = pack_jobs(jobs, spark.read.parquet(f"{tmp_dir}/chunks"), 5, ["job"], chunk_len=41)
    assert [x for r in segs.orderBy("seg_no").collect() for x in r.input_ids[1:]] == list(range(1, 2001))
    whole = segs.where("n_real = 4")._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1].split("\n:- ", 1)[1].split("\n+- ", 1)[0]
    assert "slice" in whole and "collect_list" not in whole and "Repartition" not in whole


def test_lines_with_a_place_in_their_block_are_not_dealt_to_blocks_again(spark):
    import random

    from pyspark.sql import functions as F

    from transvoc.operators import packing, prefix
    r = random.Random(8)
    rows, place = [], {}
    for f in "fg":
        for doc in range(40):
            for line in range(r.randint(0, 3)):
                n = r.randint(0, 6)
                for v in "ab":
                    at = place.get((f, v, doc // 8), 0)
                    rows.append((f, v, doc, line, [r.randint(4, 9) for _ in range(n)], at))
                    place[f, v, doc // 8] = at + n + 1
    enc = spark.createDataFrame(rows, "file string, vocab_lang string, doc_id long, line_no int, ids array<int>, at long").repartition(4)
    shown = lambda df: sorted(map(str, df.select("file", "vocab_lang", "seg_no", "input_ids", "n_real").collect()))
    want = shown(pack_segments(enc.drop("at"), 9, ["file", "vocab_lang"], docs_per_block=8))
    few = prefix.MAX_BROADCAST_BLOCKS
    try:
        for most in (few, 1):
            prefix.MAX_BROADCAST_BLOCKS = most
            got = pack_segments(enc, 9, ["file", "vocab_lang"], docs_per_block=8, within="at", alike=["vocab_lang"])
            assert shown(got) == want
    finally:
        prefix.MAX_BROADCAST_BLOCKS = few
    placed = packing.token_offsets(enc, ["file", "vocab_lang"], ["doc_id", "line_no"], docs_per_block=8, within="at", alike=["vocab_lang"])
    plan = placed.select("file", F.col("ids"), "start")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "ids" in x]
    assert "SortMergeJoin" not in plan


def test_short_ids_are_shuffled_as_short_integers(spark):
    enc = spark.createDataFrame([("c", k, 0, [k + 2 ** 15 - 9] * k) for k in range(9)], "lang string, doc_id long, line_no int, ids array<int>")
    shown = lambda df: sorted(map(str, df.collect()))
    short = pack_segments(enc, 5, below=2 ** 15)
    assert short.schema == pack_segments(enc, 5).schema and shown(short) == shown(pack_segments(enc, 5, below=2 ** 15 + 1))
    assert "smallint" in short._jdf.queryExecution().optimizedPlan().toString()
