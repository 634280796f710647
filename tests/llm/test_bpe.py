"""Byte-level BPE: equal to the tiktoken library, and an exact round trip."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transvoc.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def local_ids(text):
    find = bpe.pre_tokenizer(public_tokenizers.PATTERN)
    return [i for w in find(text) for i in bpe.merge_word(w.encode(), RANKS)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(library, text):
    assert local_ids(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sSt 1\n\t\x1c\x85\xa0!.é漢", max_size=80))
def test_awkward_text(library, text):
    assert local_ids(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 3000, "x7" * 2000, "é" * 1000, "zq" * 33])
def test_long_words(library, word):
    raw = word.encode()
    assert bpe.merge_word(raw, RANKS) == library.encode_single_piece(raw) if hasattr(library, "encode_single_piece") \
        else local_ids(word) == library.encode_ordinary(word)


def test_short_and_long_merges_agree(monkeypatch):
    words = [w.encode() for w in ("thahawh", " ononandthion", "ciónciónadobo", "aaaaabaaab", "1234567", "¡¿ßß")]
    short = [bpe.merge_word(w, RANKS) for w in words]
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    assert [bpe.merge_word(w, RANKS) for w in words] == short


@pytest.mark.parametrize("block_chars", [1, 500, bpe.BLOCK_CHARS])
def test_operator(spark, clashing, library, block_chars):
    coded = bpe.encode(clashing, PATH, public_tokenizers.PATTERN, keep=("doc_id", "text", "n_words"),
                       block_chars=block_chars)
    rows = bpe.decode(coded, PATH).collect()
    assert len(rows) == 13
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table(spark, no_docs):
    coded = bpe.encode(no_docs, PATH, public_tokenizers.PATTERN)
    assert bpe.decode(coded, PATH).collect() == []


def test_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, PATH).orderBy("k").collect()] == [None, b""]


@pytest.mark.parametrize("ids", [[max(RANKS.values()) + 1], [-1], [0, None]])
def test_unknown_ids(spark, ids):
    df = spark.createDataFrame([(1, ids)], "k int, ids array<int>")
    with pytest.raises(Exception, match="no token for id"):
        bpe.decode(df, PATH).collect()


def test_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = library.encode_ordinary(text)
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
