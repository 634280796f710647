"""The pipeline's stages: edge rows, decisions that take effect, and run() against its parts."""

import public_tokenizers
import pytest

import corpus_pipeline as C
from tests.llm.test_near_dedup import brute, plain_set
from tests.llm.test_quality import plain as plain_features
from tests.llm.test_secret_scan import plain as plain_spans
from transvoc.llm import bpe

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_edges(spark, name, stage, edge_docs, no_docs, clashing):
    for docs in (edge_docs, clashing, no_docs):
        out = stage(spark, docs, SF)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= 2 * docs.count()
    assert stage(spark, no_docs, SF).count() == 0


def test_run(spark):
    """Each stage judged on its own input, by definitions where there are any."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"]: r for r in C.quality_stage(spark, docs, SF).collect()}
    failed = {k for k, r in before.items()
              if (f := plain_features(r["text"]))[0] < 10 or 100 * f[4] > 20 * f[0]}
    assert not failed & set(kept) and all(kept[k] == before[k] for k in kept)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"]}
    assert len((good - failed) & set(kept)) >= 0.95 * len((good - failed) & set(before))

    docs = spark.createDataFrame(list(kept.values()), docs.schema)
    single = {r["doc_id"]: r for r in C.dedup_stage(spark, docs, SF).collect()}
    assert set(single) == {k for k, _, _, keep in brute([(r["doc_id"], r["text"]) for r in kept.values()]) if keep}

    docs = spark.createDataFrame(list(single.values()), docs.schema)
    clean = {r["doc_id"]: r for r in C.secrets_stage(spark, docs, SF).collect()}
    assert set(clean) == set(single)
    for k, r in clean.items():
        assert (r["text"] == single[k]["text"]) == (plain_spans(single[k]["text"]) == "")
        assert plain_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])

    docs = spark.createDataFrame(list(clean.values()), docs.schema)
    mixed = C.mix_stage(spark, docs, SF).collect()
    assert all(r == clean[r["doc_id"]] for r in mixed)
    words = sum(len(r["text"].encode().split()) for r in mixed)
    assert abs(words / sum(len(r["text"].encode().split()) for r in clean.values()) - 1.5) < 0.05

    docs = spark.createDataFrame(mixed, docs.schema)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    find = bpe.pre_tokenizer(public_tokenizers.PATTERN)
    last = C.tokens_stage(spark, docs, SF).collect()
    assert len(last) == len(mixed)
    for r in last:
        assert r["ids"] == [i for w in find(clean[r["doc_id"]]["text"]) for i in bpe.merge_word(w.encode(), ranks)]
    whole = C.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in whole) == \
        sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in last)
    assert plain_set("") == frozenset()
