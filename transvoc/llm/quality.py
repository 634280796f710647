"""Quality rules whose thresholds carry a statistical guarantee.

Every document gets features (:data:`FEATURES`).  A rule rejects a document whose
feature lies beyond a cutoff.  A stratum's cutoffs are chosen together, as a vector
with one cutoff a rule, on a labelled holdout of that stratum alone:

1. A *path* of vectors leads from "no rule" to ever stricter ones.  Each step
   tightens one rule, the one that catches the most labelled bad documents for the
   unlabelled documents it rejects.  Labelled good documents have no part in this,
   so the path is fixed as far as they are concerned.
2. The vectors are tested along the path: a vector is *safe* if the good documents
   that any of its rules rejects, ``k`` of ``n``, are so few that a true rate of
   ``risk`` would give as few only with probability ``delta`` divided by the number
   of strata (the exact binomial bound of Clopper and Pearson, with Bonferroni's
   correction).  Testing stops at the first vector that fails; in such a fixed
   sequence the tests need no further correction.
3. Of the safe vectors the one that does the most good is taken.

So with probability ``1 - delta`` no stratum loses more than ``risk`` of its good
documents to all rules together.  With the default risk and delta and four strata,
86 labelled good documents suffice for a cutoff that rejects none of them.

Scale: features are computed where a text is read and nothing but numbers leaves;
documents are reduced to counts by (stratum, rule, cutoff) and labelled ones to
counts by (stratum, step of the path) before they are collected: as many rows as
there are strata times :data:`RULES`' grid.  Texts of any length are read whole.

Defined results: null text has no words, no lines and fails the base rules (fewer
than ten words).  Null stratum values are a stratum.  A stratum without labelled
good documents, or an empty label table, has no rule beyond the base ones.  Steps
that are worth the same are taken in the order of the rules, the lenient first; of
vectors that do the same good the lenient is chosen.  An empty table gives none.
Documents with contradicting labels, or a null label, teach nothing; repeated
equal labels count once.  Repeated rows each get their verdict.  Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Fixed values of the base rules.
LEAST_WORDS, REPEAT_PERCENT = 10, 20
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_letters", "n_punct", "n_digits", "n_distinct", "n_top")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``value`` is above the cutoff; ``cutoffs`` from strict to lenient."""
    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]

    def value(self) -> Column:
        return F.when(F.col(self.bottom) > 0, F.col(self.top) / F.col(self.bottom)).otherwise(F.lit(0.0))


_SHARES = tuple(round(0.02 * i, 2) for i in range(1, 50))
RULES = (
    Rule("symbols per word", "n_symbols", "n_words", _SHARES),
    Rule("repeated words", "n_repeat_words", "n_words", _SHARES),
    Rule("repeated lines", "n_dup_lines", "n_lines", _SHARES),
    Rule("upper-case letters", "n_upper", "n_letters", _SHARES),
    Rule("punctuation", "n_punct", "word_chars", _SHARES),
    Rule("digits", "n_digits", "word_chars", _SHARES),
    Rule("commonest word", "n_top", "n_words", _SHARES),
)


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def measure(text: str | None) -> tuple[int, ...]:
    """The features of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    numbers = _Numbered()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=5)
    return (len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ids, len(numbers)), len(lines), int(kinds[1]), int(kinds[1] + kinds[2]),
            int(kinds[3]), int(kinds[4]), len(numbers), int(np.bincount(ids).max()) if len(words) else 0)


_kind: np.ndarray | None = None


def _kinds() -> np.ndarray:
    """For each code point: 1 upper case, 2 other letter, 3 punctuation or symbol, 4 digit, 0 other."""
    global _kind
    if _kind is None:
        def of(c: str) -> int:
            if c.isalpha():
                return 1 if c.isupper() else 2
            return 4 if c.isdigit() else 0 if c.isspace() or not c.isprintable() else 3
        _kind = np.fromiter((of(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)
    return _kind


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside five-word windows that occur twice or more, the first included.

    ``ids`` are the words as numbers below ``distinct``.  Windows are numbered
    exactly, one word at a time, so no two different ones can look alike.
    """
    n = len(ids) - WINDOW + 1
    if n < 2 or distinct == len(ids):
        return 0
    window = ids[:n]
    for j in range(1, WINDOW):
        window = np.unique(window * distinct + ids[j:n + j], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(window)[window] > 1)
    steps = np.zeros(len(ids) + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def features(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The ``keep`` columns of every row with its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(x.as_py()) for x in batch.column(len(keep))]
            columns = zip(*got, strict=True) if got else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns)],
                names=[*keep, *FEATURES])

    schema = docs.select(*keep).schema
    for name in FEATURES:
        schema = schema.add(name, "long")
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly in logarithms."""
    i = np.arange(k + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1))))) if k else np.zeros(1)
    return float(min(1.0, np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


@dataclass(frozen=True)
class Cutoff:
    """One rule's part in the vector of a stratum; the numbers are those of the whole vector."""
    stratum: str | None
    rule: Rule
    cutoff: float
    good: int           # labelled good documents of the stratum that pass the base rules
    good_rejected: int
    bad_rejected: int


#: A step of a path: from here on, ``rule`` (by number) rejects beyond its cutoff of this index.
Step = tuple[int, int]


def with_labels(measured: DataFrame, labels: DataFrame, *, key: str, stratum: str, label: str,
                rules: tuple[Rule, ...]) -> DataFrame:
    """``stratum`` (as a string), ``label``, ``beyond`` of rows that pass the base rules: by how many of its
    cutoffs each rule's value is beyond; label null: unlabelled."""
    agreed = (labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("__key"))
              .agg(F.min(label).alias("__label"), F.max(label).alias("__other")))
    return (measured.where(~base_failed()).join(agreed, F.col(key) == F.col("__key"), "left")
            .where(F.col("__label").isNull() | (F.col("__label") == F.col("__other")))
            .select(F.col(stratum).cast("string").alias("stratum"), (F.col("__label") != 0).cast("int").alias("label"),
                    F.array(*map(_beyond, rules)).alias("beyond")))


def _beyond(rule: Rule) -> Column:
    value = rule.value()
    return F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: c < value))


def path(bad: list[np.ndarray], other: list[np.ndarray]) -> list[Step]:
    """Steps from no rule to ever stricter ones.

    ``bad`` and ``other`` count, for each rule, the labelled bad and the unlabelled
    documents by the number of cutoffs that they are beyond.  A step's worth is
    the number of further bad documents it catches over its cost: the share of further
    others that it rejects, and, for want of others, the cutoffs it passes.
    """
    caught = [np.cumsum(b[::-1])[::-1][1:] for b in bad]        # at cutoff j: documents beyond more than j
    lost = [np.cumsum(o[::-1])[::-1][1:] for o in other]
    at = [len(c) for c in caught]
    steps = []
    while True:
        best, worth = None, 0.0
        for rule, now in enumerate(at):
            had = caught[rule][now] if now < len(caught[rule]) else 0
            paid = lost[rule][now] if now < len(lost[rule]) else 0
            for j in range(now - 1, -1, -1):
                cost = lost[rule][j] - paid + (now - j) / len(caught[rule])
                gain = (caught[rule][j] - had) / cost
                if gain > worth:
                    best, worth = (rule, j), gain
        if best is None:
            return steps
        at[best[0]] = best[1]
        steps.append(best)


def first_step(steps: list[Step], rules: tuple[Rule, ...]) -> list[list[int]]:
    """For each rule, by the number of cutoffs a value is beyond, the first step that rejects it."""
    return [[next((t for t, (r, j) in enumerate(steps) if r == rule and j < beyond), len(steps))
             for beyond in range(len(rules[rule].cutoffs) + 1)] for rule in range(len(rules))]


def best_safe_step(good: np.ndarray, bad: np.ndarray, *, risk: float, delta: float, loss: float) -> int | None:
    """The best safe step, or none.

    ``good`` and ``bad`` count labelled documents by the first step that rejects
    them; the last place counts those that no step does.  Steps are tested in order
    up to the first that fails at ``delta``.  The best rejects the largest share of
    bad documents, less ``loss`` times the share of good ones.
    """
    n = int(good.sum())
    best, most = None, 0.0
    for t in range(len(good) - 1):
        k, caught = int(good[:t + 1].sum()), int(bad[:t + 1].sum())
        if not n or binomial_tail(k, n, risk) > delta:
            break
        gain = caught / max(int(bad.sum()), 1) - loss * k / n
        if gain > most:
            best, most = t, gain
    return best


def calibrate(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang",
              label: str = "quality", rules: tuple[Rule, ...] = RULES, risk: float = 0.05,
              delta: float = 0.05, loss: float = 10.0) -> list[Cutoff]:
    """Cutoffs from the rows of ``measured`` and their labels (0: bad, others: good)."""
    rows = with_labels(measured, labels, key=key, stratum=stratum, label=label, rules=rules)
    cells = (rows.where("label is null or label = 0")
             .select("stratum", "label", F.posexplode("beyond").alias("rule", "beyond"))
             .groupBy("stratum", "label", "rule", "beyond").agg(F.count("*").alias("n")).collect())
    counts: dict = {}
    for c in cells:
        per_rule = counts.setdefault(c["stratum"], {}).setdefault(
            c["label"], [np.zeros(len(r.cutoffs) + 1, np.int64) for r in rules])
        per_rule[c["rule"]][c["beyond"]] += c["n"]
    none = [np.zeros(len(r.cutoffs) + 1, np.int64) for r in rules]
    paths = {s: path(by[0], by.get(None, none)) for s, by in counts.items() if 0 in by}
    if not paths:
        return []

    spark = measured.sparkSession
    reach = spark.createDataFrame([(s, first_step(steps, rules)) for s, steps in paths.items()],
                                  "path_stratum string, reach array<array<int>>")
    firsts = F.zip_with("reach", "beyond", lambda r, b: F.get(r, b))
    levels = (rows.where("label is not null").join(F.broadcast(reach), F.col("stratum").eqNullSafe(F.col("path_stratum")))
              .groupBy("stratum", "label", F.array_min(firsts).alias("step")).agg(F.count("*").alias("n")).collect())
    tested = {s: np.zeros((2, len(steps) + 1), np.int64) for s, steps in paths.items()}
    for c in levels:
        tested[c["stratum"]][c["label"], c["step"]] += c["n"]

    chosen = []
    strata = sum(bool(t[1].sum()) for t in tested.values())
    for s in sorted(paths, key=lambda s: (s is None, s)):
        bad, good = tested[s]
        t = best_safe_step(good, bad, risk=risk, delta=delta / max(strata, 1), loss=loss)
        if t is not None:
            vector = dict(paths[s][:t + 1])     # a rule's last step is its strictest
            chosen += [Cutoff(s, rules[r], rules[r].cutoffs[j], int(good.sum()), int(good[:t + 1].sum()),
                              int(bad[:t + 1].sum())) for r, j in sorted(vector.items())]
    return chosen


def rejected_by(cutoffs: list[Cutoff], *, stratum: str = "lang") -> Column:
    """Names of the rules that reject a row of features."""
    found = [F.when(F.col(stratum).eqNullSafe(F.lit(c.stratum)) & (c.rule.value() > c.cutoff), F.lit(c.rule.name))
             for c in cutoffs]
    if not found:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*found))


def judged(measured: DataFrame, cutoffs: list[Cutoff], *, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed``, ``rejected_by`` and ``kept``."""
    return (measured.withColumn("base_failed", base_failed())
            .withColumn("rejected_by", rejected_by(cutoffs, stratum=stratum))
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)))
