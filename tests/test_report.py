"""Report gates, skeleton, marks and the nested-metrics round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from transvoc.operators import report as R
from transvoc.sources import metrics_json as MJ


def cells(spark, rows):
    schema = "regime string, src_lang string, tgt_lang string, method string, " + ", ".join(
        f"{m} double" for m in R.METRICS)
    full = []
    for regime, s, t, method, vals in rows:
        full.append((regime, s, t, method, *[vals.get(m) for m in R.METRICS]))
    return spark.createDataFrame(full, schema)


def test_gate_is_strict_and_null_fails(spark):
    df = cells(spark, [("no-finetuning", "a", "b", "fvt", {"tgt_uid_prop": 0.2, "src_uid_prop": 0.1}),
                       ("no-finetuning", "b", "a", "fvt", {"src_uid_prop": 0.0})])
    got = {(r["src_lang"]): (r["t"], r["s"], r["p"]) for r in df.select(
        "src_lang", R.tgt_ok(0.2).alias("t"), R.src_ok(0.2).alias("s"), R.pair_ok(0.2).alias("p")).collect()}
    assert got == {"a": (False, True, False), "b": (False, True, False)}


def test_empty_group_kept_with_null_stats(spark):
    df = cells(spark, [("no-finetuning", "a", "b", "fvt",
                        {"tgt_uid_prop": 0.5, "src_uid_prop": 0.5, "tgt_norm_ppl": 1.0})])
    t = {(r["regime"], r["method"]): r for r in R.report_target(df).collect()}
    assert len(t) == 3 * 4 - 2                       # 10mb_tgt excluded in two regimes
    assert t[("no-finetuning", "fvt")]["tgt_norm_ppl_median"] is None


def test_median_and_population_std(spark):
    rows = [("no-finetuning", "a", f"t{i}", "omp",
             {"tgt_uid_prop": 0.0, "tgt_norm_ppl": v, "tgt_mbp": v, "tgt_bpt": v})
            for i, v in enumerate([1.0, 2.0, 4.0, 10.0])]
    r = [x for x in R.report_target(cells(spark, rows)).collect()
         if x["regime"] == "no-finetuning" and x["method"] == "omp"][0]
    assert r["tgt_norm_ppl_median"] == 3.0
    assert r["tgt_norm_ppl_std"] == pytest.approx(float(np.std([1.0, 2.0, 4.0, 10.0])))
    assert r["bytes_per_token"] == pytest.approx(4.25)


def test_column_ties_marked_after_rounding(spark):
    t = spark.createDataFrame([("FVT (No FT)", 11, 1.0004), ("OMP (No FT)", 12, 1.0001),
                               ("10 MB tgt (No FT)", 14, 1.2)], "label string, ord int, x double")
    r = {x["label"]: (x["rank"], x["is_best_x"]) for x in R.rank_report(t, best_min=["x"]).collect()}
    assert r == {"10 MB tgt (No FT)": (1, False), "FVT (No FT)": (2, True), "OMP (No FT)": (3, True)}


def test_best_cell_first_in_row_major_order(spark):
    t = spark.createDataFrame([("r1", 2.0, 1.0), ("r2", 1.0, 3.0)], "label string, A double, B double")
    b = R.best_cell(t, "label", ["A", "B"]).first()
    assert (b["label"], b["col"], b["value"]) == ("r1", "B", 1.0)


def test_nest_then_flatten_is_identity(spark):
    df = cells(spark, [("no-finetuning", "a", "b", "fvt", {m: float(i) for i, m in enumerate(R.METRICS)}),
                       ("no-finetuning", "a", "b", "omp", {}),
                       ("mono-finetuning", "b", "a", "fvt", {"src_mbp": 0.5})])
    docs = MJ.to_documents(MJ.nest_metrics(df))
    back = MJ.flatten(docs.select("regime", F.from_json("json", MJ.NESTED).alias("doc")))
    key = ["regime", "src_lang", "tgt_lang", "method"]
    assert sorted(map(tuple, back.select(*key, *R.METRICS).collect())) == \
        sorted(map(tuple, df.select(*key, *R.METRICS).collect()))
    assert back.filter(R.is_evaluated()).count() == 2


def test_shown_cells_to_numbers(spark):
    df = spark.createDataFrame([("1.250 (std=0.100)",), ("-3",), ("N/A",), (None,), ("x 1",), (" 2.5",)], "t string")
    assert [r[0] for r in df.select(R.to_number("t")).collect()] == [1.25, -3.0, None, None, None, 2.5]


def test_every_query_makes_its_own_matrix(spark, monkeypatch, tmp_dir):
    """What a report costs does not follow from the queries that ran before it in the session."""
    from transvoc import catalog
    from transvoc import testbed as tb
    from transvoc.queries import report  # noqa: F401 - registers them
    docs = spark.createDataFrame([(1, "de", "a"), (2, "en", "b")], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(1,)], "vec_id long").write.parquet(f"{tmp_dir}/embeddings.parquet")
    made = []

    def matrix(spark, sf_dir):
        made.append(sf_dir)
        return cells(spark, [("no-finetuning", "de", "en", "fvt", {"tgt_norm_ppl": float(len(made))})]).withColumnRenamed(
            "method", "label")

    monkeypatch.setattr(tb, "pair_matrix", matrix)
    for n, name in enumerate(("pair_metrics", "quality_gates", "method_selection", "report_pivot_tgt"), 1):
        assert catalog.QUERIES[name](spark, tmp_dir).count() > 0
        assert len(made) == n
