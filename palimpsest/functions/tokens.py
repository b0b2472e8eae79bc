"""Character classes and the word splitter for mixed Japanese and Latin text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import let, quote

# Character classes.
HIRAGANA = r"\x{3041}-\x{309F}"
KANA_COMMON = r"\x{30A0}\x{30FB}\x{30FC}"
KATAKANA = r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{3099}-\x{309C}"
PUNCTUATION = r"\x{3000}-\x{303F}"
ASCII = r"\x00-\x7F"
ALNUM = r"0-9A-Za-z@_+\-"
KANJI = r"\x{4E00}-\x{9FCF}\x{F900}-\x{FAFF}\x{3400}-\x{4DBF}"

CLASSES = {"hiragana": HIRAGANA, "kana_common": KANA_COMMON, "katakana": KATAKANA, "wide_punctuation": PUNCTUATION, "ascii": ASCII, "alnum": ALNUM, "kanji": KANJI}

_OTHER = rf"[^{ASCII}{PUNCTUATION}{HIRAGANA}\x{{30A0}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}]"
TOKEN = rf"[{ALNUM}]+|[{HIRAGANA}]+|[\x{{30A0}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}]+|{_OTHER}+"
#: A dropped character at the end leaves a trailing blank, unless it is the only sign after an "other" word.
_DROPPED_END = rf"[\x00-*,./:-?\[-\^`{{-\x7F{PUNCTUATION}]$"
_CLOSED_END = rf"{_OTHER}[{PUNCTUATION}]$"


def has(c: Column, name: str) -> Column:
    return c.rlike(f"[{CLASSES[name]}]")


def count_of(c: Column, name: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"[{CLASSES[name]}]", ""))


def is_japanese(c: Column) -> Column:
    return c.rlike(f"[{HIRAGANA}{KATAKANA}{KANJI}]")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def any_token(c: Column) -> Column:
    """The index form is not empty; no token is cut out for that."""
    return c.rlike(TOKEN)


def split_words(c: Column) -> Column:
    """Words of one class each, joined by single blanks; the index form of a line."""
    end = F.substring(c, -2, 2)
    tail = end.rlike(r"(?s)" + _DROPPED_END.replace("$", r"\z")) & ~end.rlike(_CLOSED_END.replace("$", r"\z"))
    return let(tokens(c), lambda t: F.concat(F.array_join(t, " "), F.when((F.size(t) > 0) & tail, " ").otherwise("")))


def split_words_sql(e: str) -> str:
    t = f"regexp_extract_all({e}, {quote(TOKEN)})"
    end, closed = quote(_DROPPED_END.replace("$", r"\z")), quote(_CLOSED_END.replace("$", r"\z"))
    return f"array_to_string({t}, ' ') || CASE WHEN len({t}) > 0 AND regexp_matches({e}, {end}) AND NOT regexp_matches({e}, {closed}) THEN ' ' ELSE '' END"


def word_count(idx: Column) -> Column:
    """Pieces of an index line between blanks; the empty line counts one."""
    return F.size(F.split(idx, " "))


def pieces(c: Column) -> Column:
    """What the line comparison counts: pieces between blanks of the trimmed line, without empty ones."""
    return F.filter(F.split(F.trim(c), " "), lambda x: x != "")


def pieces_sql(e: str) -> str:
    return f"list_filter(string_split(trim({e}), ' '), lambda x: x <> '')"
