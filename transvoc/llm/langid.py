"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent character n-grams, in
order of frequency.  A document gets the same kind of list, and the language
whose profile is nearest by the *out-of-place* distance: the sum, over the
document's n-grams, of the difference of the two ranks, with the profile
length for an n-gram that the profile does not have.

N-grams are taken inside words (runs of letters, lower-cased) padded with one
blank on each side, for n = 1, 2, 3; an n-gram is held as one 64-bit integer of
three 21-bit code points, so every script is covered without an alphabet.

Scale: learning is one scan with partial counts per task (flushed at a fixed
number of entries) and one small shuffle; only the profiles,
``languages x profile_size`` rows, reach the driver.  Prediction is a scan
without a shuffle.

Defined results: null text, or text with no letter: ``und`` with score 0.
Ties in frequency go to the smaller n-gram code, ties in distance to the
smaller language by code point.  Rows with null ``lang`` teach nothing; with no
labelled row at all every document is ``und``.  Repeated rows count as often as
they occur.  All other columns of the input are left untouched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
PROFILE_SIZE = 400
#: Entries of a task's partial counts before they are handed on.
FLUSH_ENTRIES = 1_000_000
BLANK = 32

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter (made once per worker)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def gram_codes(text: str | None) -> np.ndarray:
    """All n-grams (n = 1..3) of the words of ``text``, as integer codes."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    # One blank for each run of other characters, and one at either end.
    ends_word = np.empty_like(letter)
    ends_word[0] = False
    ends_word[1:] = letter[:-1] & ~letter[1:]
    kept = letter | ends_word
    body = np.where(letter, points, BLANK)[kept].astype(np.int64)
    if body[-1] != BLANK:
        body = np.append(body, BLANK)
    x = np.empty(len(body) + 1, np.int64)
    x[0], x[1:] = BLANK, body
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate([x[x != BLANK], two, three[x[1:-1] != BLANK]])


def ranked_grams(text: str | None, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams of ``text``, most frequent first."""
    codes = gram_codes(text)
    if not len(codes):
        return codes
    codes.sort()
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    counts = np.diff(np.append(starts, len(codes)))
    order = np.argsort(-counts, kind="stable")[:size]  # grams ascend, so ties go to the smaller
    return codes[starts[order]]


def learn_profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang",
                   size: int = PROFILE_SIZE) -> DataFrame:
    """Profiles ``lang, gram, rank`` (from 0) of the labelled rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        entries = 0

        def merged(parts):
            codes = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            grams, where = np.unique(codes, return_inverse=True)
            return grams, np.bincount(where, weights=n, minlength=len(grams)).astype(np.int64)

        def out():
            for label, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([label] * len(grams), pa.string()),
                     "gram": pa.array(grams, pa.int64()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for label, body in zip(batch.column(0), batch.column(1), strict=True):
                codes = gram_codes(body.as_py())
                if not len(codes):
                    continue
                codes.sort()
                starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                held.setdefault(label.as_py(), []).append(
                    (codes[starts], np.diff(np.append(starts, len(codes)))))
                entries += len(starts)
                if entries >= FLUSH_ENTRIES:
                    held = {k: [merged(v)] for k, v in held.items()}
                    entries = sum(len(v[0][0]) for v in held.values())
                    if entries >= FLUSH_ENTRIES // 2:
                        yield from out()
                        held, entries = {}, 0
        yield from out()

    counts = (docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
              .select(F.col(lang).alias("lang"), F.col(text).alias("text"))
              .mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Spark keeps the first ``size`` rows of a language in each task before it shuffles them.
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return (counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
            .select("lang", "gram", (F.col("place") - 1).alias("rank")))


class Profiles:
    """The learned lists, as postings: n-gram -> (language, rank) pairs."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        number = {label: i for i, label in enumerate(self.langs)}
        rows = sorted(rows, key=lambda r: r[1])
        gram = np.array([r[1] for r in rows], np.int64)
        self.lang = np.array([number[r[0]] for r in rows], np.int64)
        self.rank = np.array([r[2] for r in rows], np.int64)
        self.grams, self.first = np.unique(gram, return_index=True)
        self.count = np.diff(np.append(self.first, len(gram)))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 - (its distance / the largest possible)."""
        own = ranked_grams(text, self.size)
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = np.flatnonzero(self.grams[at] == own)
        n = self.count[at[known]]
        posting = np.repeat(self.first[at[known]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own_rank = np.repeat(known, n)
        saved = self.size - np.abs(self.rank[posting] - own_rank)
        saving = np.bincount(self.lang[posting], weights=saved, minlength=len(self.langs))
        best = int(np.argmax(saving))
        return self.langs[best], float(saving[best]) / (self.size * len(own))


def collect_profiles(profiles: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """The model on the driver: ``size`` entries for each learned label."""
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()], size)


def predict(docs: DataFrame, model: Profiles, *, text: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row plus ``lang_pred`` and ``score`` (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.nearest(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))),
                 pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())],
                names=[*keep, "lang_pred", "score"])

    cols = [F.col(c) for c in keep]
    schema = docs.select(*cols).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*cols, F.col(text).alias("__text")).mapInArrow(run, schema)
