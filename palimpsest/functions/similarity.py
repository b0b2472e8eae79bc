"""Similarity of two lines: by words, by characters, by word beginnings, by containment.

The longest common subsequence has two backends with equal results: an expression over arrays
(no Python, fine for short lines) and an Arrow function with bit-parallel rows for long ones.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import normalize as N
from .normalize import strip_all, trim_separator
from .tokens import pieces


def lcs_native(a: Column, b: Column, same=lambda x, y: x == y) -> Column:
    """Length of the longest common subsequence of two arrays, row by row of the usual table."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(prev: Column, w: Column) -> Column:
        step = lambda acc, j: F.array_append(acc, F.greatest(F.when(same(w, F.element_at(b, j)), F.element_at(prev, j) + 1).otherwise(0), F.element_at(prev, j + 1), F.element_at(acc, j)))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), step)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def lcs_length(a, b) -> int:
    """Bit-parallel: one machine-word operation serves many cells."""
    if len(a) > len(b):
        a, b = b, a
    at = _places(a)
    return _longest(len(a), map(at.get, b))


def _places(a) -> dict:
    """The places of each value as bits."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    return at


def _longest(n: int, agreeing: Iterable[int | None]) -> int:
    """Longest common subsequence of n values and a row of others, of each of which is given with which of the n it
    agrees."""
    full = (1 << n) - 1
    v = full
    for m in agreeing:
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@F.pandas_udf(IntegerType())
def lcs_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(IntegerType())
def lcs_chars_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


def word_rate(a: Column, b: Column, lcs: Column, separators: bool = False) -> tuple[Column, Column, Column]:
    """(match, total, rate) of two piece arrays. With ``separators`` the blanks between pieces count too:
    n pieces are then 2n - 1, and every matched neighbourhood shares its blank."""
    n, m = F.size(a), F.size(b)
    if separators:
        n, m = F.greatest(2 * n - 1, F.lit(0)), F.greatest(2 * m - 1, F.lit(0))
    total = F.greatest(n, m)
    return lcs, total, F.try_divide(lcs.cast("double"), total.cast("double"))


def with_blanks(a: Column, blank: str | int = " ") -> Column:
    """Pieces with their separators between them."""
    return F.slice(F.flatten(F.transform(a, lambda x: F.array(x, F.lit(blank)))), 1, F.greatest(2 * F.size(a) - 1, F.lit(0)))


def char_rate(a: Column, b: Column, lcs: Column) -> tuple[Column, Column, Column]:
    """(match, total, rate) by characters of the first line: deletions and insertions both count against it."""
    match = F.greatest(2 * lcs - F.length(b), F.lit(0))
    return match, F.length(a), F.try_divide(match.cast("double"), F.length(a).cast("double"))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def compared(c: Column) -> Column:
    return trim_separator(c)


def prefix_lcs(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(match, words, alike): words agree when one begins the other; alike from 80 %."""
    x, y = pieces(strip_all(a)), pieces(strip_all(b))
    match = prefix_lcs_arrow(x, y)
    return match, F.size(x), F.when(F.size(x) == 0, F.size(y) == 0).otherwise(match / F.size(x) >= 0.8)


def prefix_lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence in which words agree when one begins the other. The words that begin with a word
    stand together in order, those that it begins with are looked up by length; each word of ``b`` asks once."""
    at = _places(a)
    words, known = sorted(at), {}
    for y in set(b):
        m = 0
        for size in range(1, len(y)):
            m |= at.get(y[:size], 0)
        i = bisect_left(words, y)
        while i < len(words) and words[i].startswith(y):
            m |= at[words[i]]
            i += 1
        known[y] = m
    return _longest(len(a), map(known.get, b))


@F.pandas_udf(IntegerType())
def prefix_lcs_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([prefix_lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def contains_either(a: Column, b: Column) -> Column:
    """One holds the other, symbols and blanks aside."""
    return either_in(N.bare(a), N.bare(b))


def either_in(x: Column, y: Column) -> Column:
    return F.contains(x, y) | F.contains(y, x)


def common_substring(a: str, b: str) -> int:
    """Longest common run of two texts, blanks aside: one text's suffix automaton, walked with the other."""
    a, b = "".join(a.split()), "".join(b.split())
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    step: list[dict[str, int]] = [{}]
    size, link, last = [0], [-1], 0
    for c in b:
        new, at = len(size), last
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                twin = len(size)
                step.append(dict(step[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    best = at = run = 0
    for c in a:
        while at and c not in step[at]:
            at = link[at]
            run = size[at]
        if c in step[at]:
            at = step[at][c]
            run += 1
            best = max(best, run)
    return best


@F.pandas_udf(IntegerType())
def common_substring_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_substring(x or "", y or "") for x, y in zip(a, b)], dtype="int32")


_MATH, _SIGNS = (N.compiled(x)[0][0] for x in (N.MATH, N.PUNCTUATION))
_WIDTHS = str.maketrans(N.WIDE + N.HALF_KANA, N.NARROW + N.FULL_KANA)
#: Quotes, dashes and marks become quotes first, and those are signs.
_QUOTED = [p for p, _ in N.compiled(N.SPACES + N.QUOTES)]


@lru_cache(maxsize=1 << 16)
def _bare(c: str) -> str:
    """What ``strip_all`` leaves of one character, blanks aside."""
    if _MATH.match(c) or any(p.match(c) for p in _QUOTED):
        return ""
    c = c.translate(_WIDTHS)
    gone = c.isspace() or _SIGNS.match(c) or ord(c) > 0xFFFF or unicodedata.category(c) in ("Cc", "Cf", "Co")
    return "" if gone else c


def bared(text: str) -> tuple[str, list[int]]:
    """A text without blanks and symbols, and the place of each character that is left."""
    signs = list(map(_bare, text))
    return "".join(signs), [i for i, c in enumerate(signs) if c]


def beginnings(part: str, whole: str) -> list[int]:
    """How much of the beginning of ``part`` stands at each place of ``whole`` (Z-function)."""
    text = f"{part}\0{whole}"
    z, left, right = [0] * len(text), 0, 0
    for i in range(1, len(text)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(text) and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z[len(part) + 1 :]


def overlap_offset(a: str, b: str) -> int | None:
    """Where ``b`` starts relative to ``a`` when the texts overlap, blanks and symbols aside: the longest beginning
    of either that the other holds, no shorter than their longest common run; none without overlap."""
    least = common_substring(a, b)
    bare = bared(a), bared(b)
    for (whole, places), (part, own), size, sign in ((*bare, len(b), 1), (*bare[::-1], len(a), -1)):
        at = beginnings(part, whole) if part and whole else []
        most = max(at, default=0)
        long = size if most == len(part) else own[most]
        if most and long >= least and (offset := places[at.index(most)] - own[0]) >= 0:
            return sign * offset
    return None


@F.pandas_udf(IntegerType())
def overlap_offset_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_offset(x or "", y or "") for x, y in zip(a, b)], dtype="Int32")
