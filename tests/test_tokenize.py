"""Tokenizers against pure-Python models."""

import random

import pytest

from pyspark.sql import functions as F

from transvoc.operators.tokenize import encode, encode_long
from transvoc.operators.trie import Trie, greedy_pieces
from transvoc.operators.vocab import build_vocab, piece_vocab, top_k_per_group

UNK = 1


def py_greedy(word, table, L):
    i, out = 0, []
    while i < len(word):
        for l in range(min(L, len(word) - i), 0, -1):
            if word[i:i + l] in table:
                out.append(table[word[i:i + l]])
                i += l
                break
        else:
            out.append(UNK)
            i += 1
    return out


def vocab_df(spark, table, lang="xx"):
    return spark.createDataFrame([(lang, t, i) for t, i in table.items()],
                                 "lang string, token string, id int")


def test_greedy_matches_python(spark):
    table = {"ab": 4, "abc": 5, "c": 6, "d": 7, "bcd": 8, "\U0001F600": 9, "e": 10}
    rnd = random.Random(3)
    alphabet = "abcde\U0001F600z"
    words = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 9)))
                    for _ in range(200)})
    wdf = spark.createDataFrame([("xx", w) for w in words], "vocab_lang string, word string")
    expect = {w: py_greedy(w, table, 3) for w in words}
    for batch in (7, 50_000):
        got = {r["word"]: list(r["ids"]) for r in
               greedy_pieces(wdf, vocab_df(spark, table), batch_words=batch).collect()}
        assert got == expect


def test_trie_takes_the_longest_entry_and_falls_back():
    trie = Trie([("a", 4), ("abcd", 5), ("bc", 6), ("a", 9), ("", 8)])
    assert trie.pieces("abcd") == [5] and trie.pieces("abce") == [4, 6, UNK] and trie.pieces("") == []
    assert Trie([]).pieces("xy") == [UNK, UNK]


def test_greedy_words_of_an_unknown_language(spark):
    wdf = spark.createDataFrame([("xx", "ab"), ("yy", "ab")], "vocab_lang string, word string")
    got = {r["vocab_lang"]: list(r["ids"]) for r in greedy_pieces(wdf, vocab_df(spark, {"ab": 4})).collect()}
    assert got == {"xx": [4], "yy": [UNK, UNK]}


def test_greedy_takes_entries_of_any_length(spark):
    table = {"a" * 30: 4, "a": 5}
    wdf = spark.createDataFrame([("xx", "a" * 30), ("xx", "a" * 31)], "vocab_lang string, word string")
    got = {r["word"]: list(r["ids"]) for r in greedy_pieces(wdf, vocab_df(spark, table)).collect()}
    assert got == {"a" * 30: [4], "a" * 31: [4, 5]}


def test_word_encode_unknown_and_empty(spark):
    v = vocab_df(spark, {"a": 4, "b": 5})
    lines = spark.createDataFrame([("xx", 0, 0, "a b c"), ("xx", 0, 1, ""), ("xx", 0, 2, "b  a")],
                                  "lang string, doc_id long, line_no int, line string")
    got = {r["line_no"]: list(r["ids"]) for r in encode(lines, v, "word", "same", known_entries=2).collect()}
    assert got == {0: [4, 5, UNK], 1: [], 2: [5, UNK, 4]}
    # join plan (no broadcast bound) gives the same ids
    got2 = {r["line_no"]: list(r["ids"]) for r in encode(lines, v, "word", "same").collect()}
    assert got2 == got
    rows = encode_long(lines, v, "same", known_entries=2).filter("line_no = 0").orderBy("pos").collect()
    assert [(r["token_id"], r["prev_id"]) for r in rows] == [(4, 2), (5, 4), (UNK, 5)]


@pytest.mark.parametrize("most", [1, 3, 30])
@pytest.mark.parametrize("k", [1, 25, 499, 5000])
def test_top_k_is_exact(spark, k, most):
    rnd = random.Random(5)
    rows = [("a" if i % 4 else "b", f"w{i}", rnd.randint(1, most)) for i in range(2000)]
    df = spark.createDataFrame(rows, "lang string, token string, n long")
    got = {(r["lang"], r["token"]): r["rank"] for r in top_k_per_group(df, "lang", k).collect()}
    expect = {}
    for lang in ("a", "b"):
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[2], r[1]))[:k]
        expect |= {(lang, r[1]): i for i, r in enumerate(best, 1)}
    assert got == expect


def test_build_vocab_ids_and_pieces(spark):
    lines = spark.createDataFrame([("xx", 0, 0, "b a b"), ("xx", 0, 1, "c b a")],
                                  "lang string, doc_id long, line_no int, line string")
    v = build_vocab(lines, 2)
    assert {(r["token"], r["id"]) for r in v.collect()} == {("b", 4), ("a", 5)}
    pv = piece_vocab(v, lines)
    assert {(r["token"], r["id"]) for r in pv.collect()} == {("b", 4), ("a", 5), ("c", 6)}


def test_word_encode_in_batches_equals_joins(spark):
    vocab = spark.createDataFrame([("s", "a", 4), ("s", "b", 5), ("t", "b", 4), ("t", "", 5)], "lang string, token string, id int")
    rows = [("s", 1, 0, "a b a a c"), ("s", 1, 0, "b a b"), ("s", 1, 0, ""), ("s", 1, 0, ""), ("t", None, 1, "b  b q"),
            (None, 2, 0, "a b"), ("u", 3, 0, "a b"), ("t", 3, 1, ""), ("t", 3, 2, None)]
    lines = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, line string")
    shown = lambda df: sorted(map(str, df.select("vocab_lang", "lang", "doc_id", "line_no", "ids").collect()))
    for pairs in ("same", "all"):
        for max_len in (None, 2):
            got = encode(lines, vocab, "word", pairs, max_len=max_len, known_entries=4)
            want = encode(lines, vocab, "word", pairs, max_len=max_len, known_entries=4, max_broadcast_entries=3)
            assert shown(got) == shown(want) != []
    plan = encode(lines, vocab, "word", "same", known_entries=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row a token, and every line is read once


def test_lines_of_several_vocabularies_are_shuffled_once(spark):
    vocab = spark.createDataFrame([("s", "a", 4), ("s", "b", 5), ("t", "b", 4), ("t", "", 5)], "lang string, token string, id int")
    rows = [("f", 1, 0, "a b a a c"), ("f", 1, 0, "b a b"), ("f", 1, 0, ""), ("f", 1, 0, ""), ("g", None, 1, "b  b q"),
            (None, 2, 0, "a b"), ("h", 3, 0, "a b"), ("g", 3, 1, ""), ("g", 3, 2, None), ("g", None, 1, "q a a b")]
    lines = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, line string")
    pairs = spark.createDataFrame([("s", "f"), ("t", "f"), ("t", "g"), ("u", "g")], "vocab_lang string, lang string")
    shown = lambda df: sorted(map(str, df.select("vocab_lang", "lang", "doc_id", "line_no", "ids").collect()))
    for max_len in (None, 2):
        got = encode(lines, vocab, "word", pairs, max_len=max_len, known_entries=4)
        want = encode(lines, vocab, "word", pairs, max_len=max_len, known_entries=4, max_broadcast_entries=3)
        assert shown(got) == shown(want) != []
    plan = encode(lines, vocab, "word", pairs, known_entries=4)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning" in x and "doc_id" in x]
    assert len(dealt) == 1 and "vocab_lang" not in dealt[0]


def test_lines_dealt_by_block_know_their_place(spark):
    vocab = spark.createDataFrame([("s", "a", 4), ("t", "b", 4)], "lang string, token string, id int")
    rnd = random.Random(3)
    rows = [(lang, doc, n, " ".join(rnd.choices("abc", k=rnd.randint(0, 4)))) for lang in "fg" for doc in range(-5, 30)
            for n in range(rnd.randint(0, 4))]
    rows += [("f", 7, 9, x) for x in ("a b", "", "c", "", "")] + [("g", None, 0, "a"), ("f", 8, 0, None)]
    lines = spark.createDataFrame(rows, "lang string, doc_id long, line_no int, line string").repartition(5)
    pairs = spark.createDataFrame([("s", "f"), ("t", "f"), ("t", "g")], "vocab_lang string, lang string")
    block = F.expr("doc_id div 4")
    plain = encode(lines, vocab, "word", pairs, known_entries=2)
    got = encode(lines, vocab, "word", pairs, known_entries=2, block=block)
    shown = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert shown(got) == shown(plain)
    of = {}
    for r in got.where("doc_id IS NOT NULL").orderBy("doc_id", "line_no", "before").collect():
        of.setdefault((r.vocab_lang, r.lang, int(r.doc_id / 4)), []).append((r.before, len(r.ids) + 1))
    assert all(at == sum(n for _, n in own[:k]) for own in of.values() for k, (at, _) in enumerate(own))
    assert {k[0] + k[1] for k in of} == {"sf", "tf", "tg"}
    with pytest.raises(ValueError):
        encode(lines, vocab, "word", pairs, known_entries=2, block=block, max_len=3)


def test_score_hashes_a_large_bigram_table(spark):
    from transvoc.operators import lm as lm_ops
    lm = spark.createDataFrame([("s", 2, 4, 3), ("s", 4, 4, 1), ("s", 4, 1, 2)], "lang string, prev int, tok int, n long")
    rows = spark.createDataFrame([("s", p, t) for p in (1, 2, 4) for t in (1, 4, 5)] + [(None, 2, 4)],
                                 "vocab_lang string, prev_id int, token_id int")
    few, many = (lm_ops.score(rows, lm, 6, lm_rows=n) for n in (3, lm_ops.SMALL_LM + 1))
    assert "ShuffledHashJoin" in many._jdf.queryExecution().executedPlan().toString()  # labels are not sorted to meet it
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_words_of_the_pool_are_counted_once(spark):
    from transvoc.operators import vocab as VO
    from transvoc.testbed import Models
    rows = [("s", "a b a"), ("s", "b  c"), (None, "a"), ("t", ""), ("t", None), ("t", " x "), ("s", "a b a")]
    lines = spark.createDataFrame(rows, "lang string, line string")
    want = VO.line_tokens(lines).groupBy("lang", "token").count().collect()
    counts = VO.counted_words(lines)
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(map(str, map(tuple, want)))
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()  # a row a distinct word of a task, not a word
    m = Models(spark, "nowhere")  # both vocabularies come from the written counts: no text is read
    m._cache["pool_words"] = counts
    assert sorted(map(tuple, m.vocab.collect())) == sorted(map(tuple, VO.build_vocab(lines, 2000).collect()))
    assert sorted(map(tuple, m.pieces.collect())) == sorted(map(tuple, VO.piece_vocab(m.vocab, lines).collect()))


def test_characters_are_gathered_in_batches(spark):
    from transvoc.operators.vocab import counted_piece_vocab
    vocab = spark.createDataFrame([("s", "ab", 4), ("s", "a", 5), ("t", "ß", 4)], "lang string, token string, id int")
    counts = spark.createDataFrame([("s", "ab😀", 1), ("s", "", 3), ("s", None, 1), ("t", "ßé", 1), (None, "zz", 1), ("u", "x", 1)],
                                   "lang string, token string, n long")
    got = counted_piece_vocab(vocab, counts)
    assert sorted(map(tuple, got.collect())) == [("s", "a", 5), ("s", "ab", 4), ("s", "b", 6), ("s", "😀", 7),
                                                 ("t", "ß", 4), ("t", "é", 5)]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
