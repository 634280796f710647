"""Rank-order language profiles: against the plain definition, and on held-out documents."""

from collections import Counter

import numpy as np
import pytest

from transvoc.llm import langid, queries

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    grams = Counter()
    # Neighbouring words share the blank between them, so a pair of blanks is never a gram.
    joined = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i:i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                grams[g] += 1
    return grams


def code(gram):
    value = 0
    for c in gram:
        value = (value << 21) | ord(c)
    return value


@pytest.mark.parametrize("text", ["The cat; the HAT", "a", "été 漢字 x1y", "", None, "1234 !?"])
def test_grams(text):
    got = Counter(int(c) for c in langid.gram_codes(text))
    assert got == Counter({code(g): n for g, n in plain_grams(text).items()})


def test_rank_ties_go_to_smaller_code():
    assert list(langid.ranked_grams("ba", 2)) == sorted(map(code, ["b", "a", " b", "ba", "a ", " ba", "ba "]))[:2]


def test_distance_is_out_of_place():
    lists = {"aa": [code(g) for g in ("a", "b", "c", " a")], "bb": [code(g) for g in ("c", "b", "z", "a")]}
    rows = [(lang, g, i) for lang, grams in lists.items() for i, g in enumerate(grams)]
    model = langid.Profiles(rows, 4)
    own = langid.ranked_grams("cab cab ba", 4)
    distances = {}
    for lang, grams in lists.items():
        distances[lang] = sum(abs(grams.index(g) - i) if g in grams else 4 for i, g in enumerate(own.tolist()))
    best = min(sorted(distances), key=distances.get)
    lang, score = model.nearest("cab cab ba")
    assert lang == best and score == pytest.approx(1 - distances[best] / (4 * len(own)))


def test_profiles_count_all_rows(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(langid, "FLUSH_ENTRIES", 50)
    got = {}
    for r in langid.learn_profiles(edge_docs, size=30).collect():
        got.setdefault(r["lang"], {})[r["rank"]] = r["gram"]
    total = {}
    for r in edge_docs.collect():
        if r["lang"] and r["text"]:
            total.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    for lang, grams in total.items():
        order = sorted(((-n, code(g)) for g, n in grams.items()))[:30]
        assert [got[lang][i] for i in range(len(order))] == [g for _, g in order]


def test_edges(spark, edge_docs, no_docs, clashing):
    model = langid.collect_profiles(langid.learn_profiles(edge_docs))
    rows = langid.predict(clashing, model).collect()
    assert len(rows) == 13
    for r in rows:
        assert 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r for r in rows}
    for i in (3, 4, 5):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    nothing = langid.collect_profiles(langid.learn_profiles(no_docs))
    assert {r["lang_pred"] for r in langid.predict(edge_docs, nothing).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, SF).toPandas()
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and list(got.columns[:4]) == ["doc_id", "held_out", "lang_pred", "score"]
    out = both[both["held_out"]]
    assert 0 < len(out) < len(both) and np.mean(out["lang"] == out["lang_pred"]) >= 0.97
