"""Metric edge cases with a hand-made vocabulary and bigram table."""

import math

import pytest

from transvoc.operators import metrics

V = 6.0  # ids 0..5


@pytest.fixture()
def model(spark):
    vocab = spark.createDataFrame([("xx", "a", 4), ("xx", "b", 5)], "lang string, token string, id int")
    lm = spark.createDataFrame([("xx", 2, 4, 3), ("xx", 4, 5, 2), ("xx", 5, 4, 1)],
                               "lang string, prev int, tok int, n long")
    return vocab, lm


def nll(c, n, a=0.1):
    return -math.log((c + a) / (n + a * V))


def lines_df(spark, rows):
    return spark.createDataFrame([("xx", 0, i, s) for i, s in enumerate(rows)],
                                 "lang string, doc_id long, line_no int, line string")


def test_all_unknown_line(spark, model):
    vocab, lm = model
    r = metrics.ppl_lines(lines_df(spark, ["qq ww"]), vocab, lm, known_entries=2).first()
    assert r["n_unk"] == r["n_counted"] == 2
    # first half "qq" is one token, so one label is scored at log2(V)
    assert r["surprisal"] == pytest.approx(math.log2(V))


def test_one_character_line_scores_everything(spark, model):
    vocab, lm = model
    r = metrics.ppl_lines(lines_df(spark, ["a"]), vocab, lm, known_entries=2).first()
    assert r["h"] == 0 and r["nbytes"] == 1
    assert r["surprisal"] == pytest.approx(nll(3, 3) / math.log(2))


def test_blank_lines_filtered_and_counted(spark, model):
    vocab, lm = model
    res = metrics.evaluate_ppl(lines_df(spark, ["a b", "", "  "]), vocab, lm, known_entries=2).first()
    assert res["n_lines"] == 1 and res["n_blank"] == 2
    # "a b": half "a" -> h = 1, label b | a scored
    assert res["log_ppl"] == pytest.approx(nll(2, 2) / math.log(2))
    assert res["norm_ppl"] == pytest.approx(nll(2, 2) / math.log(2) / 2)


def test_truncation_keeps_bytes_of_whole_half(spark, model):
    vocab, lm = model
    r = metrics.ppl_lines(lines_df(spark, ["a b a b a b"]), vocab, lm, max_len=3,
                          known_entries=2).first()
    assert r["truncated"] == 1 and r["n_counted"] == 2
    assert r["nbytes"] == len("a b a b a b"[len("a b a b a b") // 2:].encode())


def test_option_tie_lowest_index(spark, model):
    vocab, lm = model
    mcq = spark.createDataFrame([(0, "a", "b", ["a", "a", "a", "a"], 1),
                                 (1, "a", "b", ["b", "b", "b", "b"], 2)],
                                "item_id long, passage string, question string, answers array<string>, correct int")
    r = metrics.evaluate_mcq(mcq, vocab, lm, known_entries=2).first()
    assert r["accuracy"] == 0.5 and r["n_items"] == 2


def test_minimal_pair_tie_and_over_long(spark, model):
    vocab, lm = model
    pairs = spark.createDataFrame([("xx", 0, 0, "a a a", "a a a"), ("xx", 0, 1, "a b", "b a"),
                                   ("xx", 0, 2, "a b a b", "b a b a")],
                                  "lang string, doc_id long, line_no int, sen string, wrong_sen string")
    r = metrics.evaluate_min_pairs(pairs, vocab, lm, max_length=4, known_entries=2).first()
    # tie -> wrong, (a b) beats (b a) -> right, 4 tokens >= max_length -> wrong
    assert r["n_pairs"] == 3 and r["n_over"] == 1
    assert r["accuracy"] == pytest.approx(1 / 3)


def test_ratio_of_sums_for_compression(spark):
    rows = [("xx", "a", 4), ("xx", "b", 5), ("yy", "abc", 4), ("yy", "a", 5)]
    pieces = spark.createDataFrame(rows, "lang string, token string, id int")
    lines = lines_df(spark, ["a b", "abcabc a", ""])
    got = {r["vocab_lang"]: r for r in metrics.bytes_per_token(lines, pieces).collect()}
    # xx: a, b, then a b ? a b ? and a; yy: a, ?, then abc abc and a - and two ids a line
    assert got["xx"]["n_tokens"] == 2 + 7 + 6 and got["yy"]["n_tokens"] == 2 + 3 + 6
    assert got["xx"]["bpt"] == pytest.approx(11 / 15) and got["yy"]["bpt"] == pytest.approx(11 / 11)
    assert {r["n_bytes"] for r in got.values()} == {11}
