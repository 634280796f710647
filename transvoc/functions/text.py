"""Scalar text functions as Catalyst column expressions (FN-1..3, 5, 6, 9, 11).

All of these stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode White_Space plus the
# four separators 0x1c-0x1f; str.splitlines() (and the codecs line reader)
# additionally breaks on VT, FF, FS, GS, RS, NEL, LS and PS.
_STRIP_CLASS = r"[\s\x1c-\x1f]"
STRIP_PATTERN = rf"(?U)^{_STRIP_CLASS}+|{_STRIP_CLASS}+$"
LSTRIP_PATTERN = rf"(?U)^{_STRIP_CLASS}+"
RSTRIP_PATTERN = rf"(?U){_STRIP_CLASS}+$"
UNICODE_BREAKS = r"[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Characters Python treats as whitespace (derived by rule, not listed).
WHITESPACE = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def _edge_ws(c: Column, first: bool = True, last: bool = True) -> Column:
    cond = F.lit(False)
    if first:
        cond = cond | F.substring(c, 1, 1).isin(WHITESPACE)
    if last:
        cond = cond | F.substring(c, -1, 1).isin(WHITESPACE)
    return cond


def py_strip(col) -> Column:
    """FN-1: Python-style strip (``trim`` only removes spaces).  The regex only
    runs on values whose first or last character is whitespace."""
    c = _c(col)
    return F.when(_edge_ws(c), F.regexp_replace(c, STRIP_PATTERN, "")).otherwise(c)


def py_lstrip(col) -> Column:
    c = _c(col)
    return F.when(_edge_ws(c, last=False), F.regexp_replace(c, LSTRIP_PATTERN, "")).otherwise(c)


def py_rstrip(col) -> Column:
    c = _c(col)
    return F.when(_edge_ws(c, first=False), F.regexp_replace(c, RSTRIP_PATTERN, "")).otherwise(c)


def is_blank(col) -> Column:
    return py_strip(col) == F.lit("")


def byte_len(col) -> Column:
    """FN-2: UTF-8 byte length."""
    return F.octet_length(_c(col)).cast("long")


def _half(c: Column, first: bool) -> Column:
    n = F.char_length(c)
    h = F.floor(n / 2).cast("int")
    if first:
        return F.when(h > 0, c.substr(F.lit(1), h)).otherwise(F.lit(""))
    return c.substr(h + 1, n - h + 1)


def first_half(col) -> Column:
    """FN-3: ``line[: len(line) // 2]`` by code point."""
    return _half(_c(col), first=True)


def second_half(col) -> Column:
    """FN-3: ``line[len(line) // 2 :]`` by code point."""
    return _half(_c(col), first=False)


def lang3(col) -> Column:
    """FN-5: three-letter language prefix."""
    return F.substring(_c(col), 1, 3)


def join_prompt(*cols) -> Column:
    """FN-6: stripped parts joined by single spaces."""
    return F.concat_ws(" ", *[py_strip(c) for c in cols])


def words(col) -> Column:
    """Words of a line split on single spaces; the empty line has none."""
    c = _c(col)
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(c, " ", -1))
