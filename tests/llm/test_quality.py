"""Quality rules: features by definition, exact bounds, the guarantee on planted labels."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transvoc.llm import quality as Q
from transvoc.llm import queries

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x0b\x1c\x85", max_size=120))
def test_features(text):
    assert Q.measure(text)[:5] == plain(text)


def test_features_of_documents(spark):
    got = queries.op7_quality_rules(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept"]
    rows = {r["doc_id"]: r for r in got.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d["doc_id"]], plain(d["text"])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.3), (3, 10, 0.3), (10, 10, 0.2), (7, 400, 0.05)])
def test_binomial_tail(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
    assert Q.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_binomial_tail_of_many():
    assert Q.binomial_tail(0, 10**7, 1e-6) == pytest.approx(math.exp(-10), rel=1e-3)
    assert 0 <= Q.binomial_tail(5000, 10**6, 0.0052) < 0.01


def at(size, *beyond):
    return np.bincount(beyond, minlength=size)


def test_path():
    """The rule that catches more bad for the others it rejects comes first; a rule that catches none never."""
    bad = [at(4, *[3] * 30 + [1] * 5 + [0] * 5), at(4, *[2] * 20 + [0] * 20), at(4, *[0] * 40)]
    other = [at(4, *[3] * 10 + [1] * 20 + [0] * 70), at(4, *[1] * 50 + [0] * 50), at(4, *[2] * 50 + [0] * 50)]
    assert Q.path(bad, other) == [(1, 1), (0, 2), (0, 0)]
    # Without others a step costs the cutoffs that it passes.
    assert Q.path(bad[:1], [at(4)]) == [(0, 2), (0, 0)]
    assert Q.path([at(4)], [at(4)]) == []


def test_first_step():
    rules = (Q.Rule("r", "n_symbols", "n_words", (0.1, 0.2, 0.3)), Q.Rule("s", "n_digits", "n_words", (0.1, 0.2)))
    assert Q.first_step([(1, 1), (0, 2), (0, 0)], rules) == [[3, 2, 2, 1], [3, 3, 0]]


def best(good, bad, loss=10.0, delta=0.05):
    return Q.best_safe_step(np.array(good), np.array(bad), risk=0.05, delta=delta, loss=loss)


def test_best_safe_step():
    assert best([0, 0, 200], [5, 45, 50]) == 1
    assert best([0, 2, 198], [50, 5, 45]) == 0              # the stricter step costs more than it brings
    assert best([0, 2, 198], [50, 5, 45], loss=0) == 1
    # 86 good documents do at a quarter of delta, 85 don't; none labelled, or nothing caught: no step.
    assert best([0, 86], [5, 5], delta=0.0125) == 0
    assert best([0, 85], [5, 5], delta=0.0125) is None
    assert best([0, 0], [5, 5]) is None
    assert best([0, 200], [0, 50]) is None
    # Good documents at the first step stop the sequence.
    assert best([100, 0, 900], [50, 50, 0], loss=0) is None


def test_guarantee():
    """Over many holdouts, the share in which a stratum loses more than the risk stays below delta,
    whatever number of steps lies beyond the risk."""
    rng = random.Random(2)
    violations = 0
    for _ in range(300):
        good = [0] * 41
        for _ in range(600):    # each step rejects another 0.4 %: from the thirteenth on beyond the risk
            step = rng.random() / 0.004
            good[int(min(step, 40))] += 1
        got = best(good, [100] * 41, loss=0)
        violations += got is not None and 0.004 * (got + 1) > 0.05
    assert violations <= 0.05 * 300


def plain_cutoffs(docs, labels, risk=0.05, delta=0.05, loss=10):
    """The chosen vectors by loops over documents: ``{lang: {rule number: cutoff}}``."""
    given = {}
    for key, label in labels:
        if label is not None:
            given.setdefault(key, set()).add(label)
    pools = {}
    for key, lang, text in docs:
        f = dict(zip(Q.FEATURES, Q.measure(text), strict=True))
        if f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"] or len(given.get(key, ())) > 1:
            continue
        values = [f[r.top] / f[r.bottom] if f[r.bottom] else 0.0 for r in Q.RULES]
        pools.setdefault(lang, {0: [], 1: [], None: []})[next(iter(given.get(key, [None])))].append(values)
    strata = sum(bool(p[0] and p[1]) for p in pools.values())
    chosen = {}
    for lang, pool in pools.items():
        vector, vectors = {}, []
        while True:
            options = []
            for r, rule in enumerate(Q.RULES):
                now = vector.get(r, math.inf)
                tighter = [c for c in rule.cutoffs if c < now]
                for passed, c in enumerate(reversed(tighter), 1):
                    caught = sum(c < v[r] <= now for v in pool[0])
                    cost = sum(c < v[r] <= now for v in pool[None]) + passed / len(rule.cutoffs)
                    options.append((caught / cost, -r, -passed, c))
            gain, r, _, c = max(options)
            if gain <= 0:
                break
            vector = vector | {-r: c}
            vectors.append(vector)
        top, good, bad = 0.0, pool[1], pool[0]
        for vector in vectors:
            k, caught = (sum(any(v[r] > c for r, c in vector.items()) for v in group) for group in (good, bad))
            if not good or sum(math.comb(len(good), i) * risk**i * (1 - risk)**(len(good) - i)
                               for i in range(k + 1)) > delta / strata:
                break
            if caught / len(bad) - loss * k / len(good) > top:
                top = caught / len(bad) - loss * k / len(good)
                chosen[lang] = vector
    return chosen


def test_query_against_plain_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()
    want = plain_cutoffs([tuple(d) for d in docs], [tuple(x) for x in labels])
    assert "en" in want
    rows = {r["doc_id"]: r for r in queries.op7_quality_rules(spark, sf).collect()}
    for d in docs:
        f = dict(zip(Q.FEATURES, Q.measure(d["text"]), strict=True))
        beyond = any(f[Q.RULES[r].top] > c * f[Q.RULES[r].bottom] for r, c in want.get(d["lang"], {}).items())
        assert rows[d["doc_id"]]["kept"] == (not rows[d["doc_id"]]["base_failed"] and not beyond)


def test_planted_labels(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        words = [f"w{rng.randrange(10**6)}" + ("###" if bad else "") for _ in range(30)]
        docs.append((i, " ".join(words), "l1" if i % 20 < 10 else None))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    labels += [(1, 1), (2, 0), (3, None), (None, 0), (99999, 1)]
    measured = Q.features(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    cutoffs = Q.calibrate(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {c.stratum for c in cutoffs} == {"l1", None} and all(c.good_rejected == 0 for c in cutoffs)
    kept = {r["doc_id"] for r in Q.judged(measured, cutoffs).where("kept").collect()}
    assert kept == {i for i in range(3000) if i % 10}


def test_edges(spark, edge_docs, no_docs, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for docs in (edge_docs, clashing):
        measured = Q.features(docs)
        cutoffs = Q.calibrate(measured, labels)
        assert cutoffs == []
        rows = Q.judged(measured, cutoffs).collect()
        assert len(rows) == 13
        texts = Counter(plain(r["text"]) for r in docs.collect())
        assert Counter(tuple(r[2:7]) for r in rows) == texts
        assert not any(r["kept"] for r in rows if r["n_words"] < 10)
    assert Q.judged(Q.features(no_docs), []).collect() == []
