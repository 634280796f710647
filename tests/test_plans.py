"""Plan operators and the bigram scorer."""

import math

import pytest
from pyspark.sql import functions as F

from transvoc.operators.lm import score
from transvoc.plans import experiment as X
from transvoc.sources.mcq import read_min_pairs


def test_unknown_labels_take_their_counts_from_the_contexts(spark):
    lm = spark.createDataFrame([("xx", 2, 1, 5), ("xx", 1, 1, 9), ("xx", 1, 4, 1), ("xx", 4, 4, 2)],
                               "lang string, prev int, tok int, n long")
    rows = spark.createDataFrame([("xx", p, t) for p in (1, 2, 4, 7) for t in (1, 4, 5)],
                                 "vocab_lang string, prev_id int, token_id int")
    n, c = {2: 5, 1: 10, 4: 2}, {(2, 1): 5, (1, 1): 9, (1, 4): 1, (4, 4): 2}
    for bound in (None, 10):
        got = {(r.prev_id, r.token_id): r.loss_nats for r in score(rows, lm, 6, ctx_bound=bound).collect()}
        assert len(got) == 12
        for (p, t), loss in got.items():
            assert loss == pytest.approx(-math.log((c.get((p, t), 0) + 0.1) / (n.get(p, 0) + 0.6)))


def test_pairs_routing_and_filters(spark):
    langs = spark.createDataFrame([("aa",), ("bb",), ("cc",)], "lang string")
    mapping = X.language_mapping(langs)
    plan = X.transfer_plan(X.language_pairs(mapping))
    assert plan.count() == 3 * 2 * 2
    manifest = X.manifest_rows(plan)
    assert X.for_source(manifest, "aa").filter("finetuned").count() == 4
    jobs = X.finetune_plan(manifest)
    # per regime and source: 2 source-base + 2 target-base + 4 transferred jobs
    per = {(r["regime"], r["src_lang"]): r["count"] for r in jobs.groupBy("regime", "src_lang").count().collect()}
    assert set(per.values()) == {8}
    mono_tgt = jobs.filter("regime = 'mono-finetuning' AND kind = 'tgt_base' AND src_lang = 'aa'").first()
    assert list(mono_tgt["train"]) == ["data/train/aa.txt"]          # target base: source data only
    corpus = spark.createDataFrame([("data/train/aa.txt", 0, 0, "x"), ("data/train/bb.txt", 1, 0, "yy")],
                                   "file string, doc_id long, line_no int, line string")
    lines = X.route_lines(jobs.filter("regime = 'mixed-finetuning' AND kind = 'src_base'"), corpus)
    order = [(r["file_ord"], r["file"]) for r in
             lines.filter("out = 'aa_100mb_bb_finetuned'").orderBy("file_ord").collect()]
    assert order == [(0, "data/train/aa.txt"), (1, "data/train/bb.txt")]


def test_read_min_pairs_by_three_letter_code(spark):
    df = spark.createDataFrame([("eng_latn", "a"), ("deu_latn", "b")], "lang string, sen string")
    assert [r["sen"] for r in read_min_pairs(df, "eng_Latn".lower()).collect()] == ["a"]


def test_minimal_pairs_of_every_language(spark, tmp_dir):
    from transvoc import catalog

    catalog.load_all()
    rows = [(9, "b a", "aa"), (19, "c d", "bb"), (29, "e\n\nf g", "cc"), (39, "h i", None), (40, "j k", "aa")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = catalog.QUERIES["minimal_pairs"](spark, tmp_dir).collect()
    assert {(r.lang, r.sen, r.wrong_sen) for r in got} == {
        ("aa", "b a", "a b"), ("bb", "c d", "d c"), ("cc", "e", "e"), ("cc", "f g", "g f"), (None, "h i", "i h")}


def test_read_manifest_folder_layout(spark, tmp_dir):
    import json
    import os
    info = {"src_lang": "aa", "tgt_lang": "bb", "src_model": "m/aa_100mb", "tgt_model": "m/bb_10mb",
            "src_finetune_data": {"train": "t/aa.txt", "valid": "v/aa.txt"},
            "tgt_finetune_data": {"train": "t/bb.txt", "valid": "v/bb.txt"},
            "method": "fvt", "finetuned": False}
    for model, doc in (("aa-bb-fvt", info), ("aa-bb-omp", {**info, "method": "omp", "finetuned": True})):
        os.makedirs(os.path.join(tmp_dir, model))
        with open(os.path.join(tmp_dir, model, "transfer_info.json"), "w") as f:
            json.dump(doc, f, indent=2)
    os.makedirs(os.path.join(tmp_dir, "no-manifest"))
    with open(os.path.join(tmp_dir, "no-manifest", "config.json"), "w") as f:
        f.write("{}")
    got = {r["model"]: (r["method"], r["finetuned"], r["tgt_finetune_data"]["train"])
           for r in X.read_manifest(spark, tmp_dir, layout="folders").collect()}
    assert got == {"aa-bb-fvt": ("fvt", False, "t/bb.txt"), "aa-bb-omp": ("omp", True, "t/bb.txt")}


def test_existing_outputs_count_in_their_own_regime(spark):
    langs = spark.createDataFrame([("aa",), ("bb",)], "lang string")
    manifest = X.manifest_rows(X.transfer_plan(X.language_pairs(X.language_mapping(langs))))
    every = X.finetune_plan(manifest)
    mono = every.filter("regime = 'mono-finetuning'").select("regime", "out")
    left = X.finetune_plan(manifest, mono)
    assert {r["regime"] for r in left.collect()} == {"mixed-finetuning"}
    assert left.count() == every.filter("regime = 'mixed-finetuning'").count()
    regimes = {False: ["no-finetuning"], True: ["mono-finetuning", "mixed-finetuning"]}
    assert X.resolve_base(manifest, every.select("regime", "out"), regimes).count() == 4 + 2 * 4
    with pytest.raises(FileNotFoundError, match="2 missing"):
        X.resolve_base(manifest, mono, regimes)      # the mixed siblings are not there


def test_manifest_tree_round_trip(spark, tmp_dir):
    import os

    from transvoc.sources.manifest_tree import FILE_NAME, write_manifest_tree
    langs = spark.createDataFrame([("aa",), ("bb",)], "lang string")
    manifest = X.manifest_rows(X.transfer_plan(X.language_pairs(X.language_mapping(langs)))).filter(~F.col("finetuned"))
    write_manifest_tree(manifest.repartition(3), f"{tmp_dir}/models")
    assert sorted(os.listdir(f"{tmp_dir}/models")) == ["aa-bb-fvt", "aa-bb-omp", "bb-aa-fvt", "bb-aa-omp"]
    assert os.listdir(f"{tmp_dir}/models/aa-bb-fvt") == [FILE_NAME]
    os.makedirs(f"{tmp_dir}/models/without")  # no manifest: no row
    back = X.read_manifest(spark, f"{tmp_dir}/models", "folders")
    key = lambda df: sorted(map(str, df.select(*sorted(manifest.columns)).collect()))
    assert key(back) == key(manifest)
    jobs = spark.createDataFrame([("mono", "x_finetuned", "aa-bb-fvt"), ("mono", "base_finetuned", "models/aa_100mb")],
                                 "regime string, out string, model_spec string")
    tuned = X.tuned_manifests(jobs, back).collect()
    assert [(r.model, r.finetuned, r.src_lang) for r in tuned] == [("mono/x_finetuned", True, "aa")]
    write_manifest_tree(manifest.limit(0), f"{tmp_dir}/none")
    assert os.listdir(f"{tmp_dir}/none") == []


def test_failed_manifest_write_leaves_nothing(spark, tmp_dir):
    import os

    from transvoc.sources.manifest_tree import ManifestWriter
    from pyspark.sql import Row
    writer = ManifestWriter(f"{tmp_dir}/t")
    message = writer.write(iter([Row(model="m", src_lang="a")]))
    assert os.listdir(f"{tmp_dir}/t") == [writer.staging]
    writer.abort([message, None])
    assert os.listdir(f"{tmp_dir}/t") == []
