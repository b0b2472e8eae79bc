"""Text normalisation as ordered rewrite rules.

A rule is (pattern, replacement) in the syntax that Java's and RE2's engines share, so one table
drives both the Spark expression and, in tests and oracles, the DuckDB one. Blanks are spelled
``[\\t-\\r\\x85\\p{Z}]``, the set that a Unicode-aware ``\\s`` stands for.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\t-\r\x85\p{Z}]"
NOT_BLANK = r"[^\t-\r\x85\p{Z}]"

Rules = list[tuple[str, str]]

# Patterns and replacements of the line normaliser, in the order they are applied.
FIELD_CODE: Rules = [(BLANK + r"*SEQ Paragraph" + BLANK + r"+\\#" + BLANK + r'+"?\[[0-9]+\]"?' + BLANK + r"+(\\\*" + BLANK + r"*MERGEFORMAT" + BLANK + r"*)+", "")]
CONTROLS: Rules = [(r"[\x00-\x1F\x7F]", "")]
SPACES: Rules = [(r"[\x{A0}\x{C2A0}\x{200E}]", " ")]
SINGLE_QUOTES: Rules = [(r"[\x{91}\x{92}\x{2018}\x{2019}]", "'")]
DOUBLE_QUOTES: Rules = [(r"[\x{93}\x{94}\x{AB}\x{201C}\x{201D}]", '"')]
DASHES: Rules = [(r"[\x{97}\x{2013}\x{2014}]", '"')]
MARKS: Rules = [(r"[\x{A9}\x{AE}\x{2022}\x{2122}]", '"')]
FIGURE: Rules = [(r"(?i)(^fig| fig)\. +([^A-Z])", r"\1.\2")]
COLLAPSE: Rules = [(BLANK + "+", " ")]
PERIOD_BREAK: Rules = [(r"\. +" + BLANK + "+", ".  \n")]
FULL_STOP_BREAK: Rules = [(r"。([^\n])", "。  \n" + r"\1")]
BRACKET_LINE: Rules = [(r"([＜〔【≪《][^＞〕】≫》]+[＞〕】≫》])", "\n" + r"\1" + "\n")]
BRACKET_NUMBER: Rules = [("^" + BLANK + r"([(\[<（][0-9]+[)\]>）])", "\n" + r"\1" + "\n")]
NUMBER_LINE: Rules = [("^" + BLANK + r"*([0-9]+)(\.?)" + BLANK + "+", "\n" + r"\1\2" + "\n")]
PUNCTUATION: Rules = [(r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")]
#: Control, format and private-use characters, and all beyond the basic plane.
UNPRINTABLE: Rules = [(r"[\p{Cc}\p{Cf}\p{Co}\x{10000}-\x{10FFFF}]", "")]
MATH: Rules = [(r"[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}\x{2100}-\x{214F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{2300}-\x{23FF}\x{25A0}-\x{25FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2A00}-\x{2AFF}\x{2B00}-\x{2BFF}]", "")]
#: The simpler variant of the normaliser breaks lines at other places.
PLAIN_PERIOD: Rules = [(r"\. +", ".  \n")]
PLAIN_FULL_STOP: Rules = [(r"。([^\n])", "。  \n(" + r"\1" + ")")]
PLAIN_BRACKET: Rules = [(r"^((([(\[<（＜〔【≪《])([^0-9]*[0-9]*)([)\]>）＞〕】≫》])(" + BLANK + r"*))+)", "\n" + r"\1" + "  \n")]
PLAIN_NUMBER: Rules = [(r"^([0-9]+)(\.?)", "\n" + r"\1\2" + "  \n")]

#: Full-width forms and the ideographic space, by rule: U+FF01..FF5E lie 0xFEE0 above ASCII.
WIDE = "　" + "".join(chr(0xFF01 + i) for i in range(94))
NARROW = " " + "".join(chr(0x21 + i) for i in range(94))
#: Half-width katakana U+FF61..FF9F and their full-width forms, in code order.
HALF_KANA = "".join(chr(0xFF61 + i) for i in range(63))
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"

QUOTES: Rules = SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + MARKS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apply(c: Column, rules: Rules) -> Column:
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new.replace("\\1", "$1").replace("\\2", "$2"))
    return c


def compiled(rules: Rules) -> list[tuple[re.Pattern, str]]:
    """The same rules for Python's engine."""

    def pattern(p: str) -> str:
        p = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), p)
        return p.replace(r"\p{Z}", " \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000").replace("[[", r"[\[")

    return [(re.compile(pattern(p)), r) for p, r in rules]


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(expr: str, rules: Rules) -> str:
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(new)}, 'g')"
    return expr


def zen_to_han(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


def han_to_zen(c: Column) -> Column:
    """Half-width katakana, one character at a time: voice marks stay apart."""
    return F.translate(c, HALF_KANA, FULL_KANA)


def widths(c: Column) -> Column:
    return han_to_zen(zen_to_han(c))


def widths_sql(expr: str) -> str:
    return f"translate(translate({expr}, {quote(WIDE)}, {quote(NARROW)}), {quote(HALF_KANA)}, {quote(FULL_KANA)})"


FIRST = FIELD_CODE + CONTROLS + SPACES + QUOTES + FIGURE + COLLAPSE + PERIOD_BREAK + FULL_STOP_BREAK
LAST = BRACKET_LINE + BRACKET_NUMBER + NUMBER_LINE
PLAIN_FIRST: Rules = CONTROLS + [(r"[\x{A0}\x{C2A0}]", " ")] + QUOTES + FIGURE + COLLAPSE + PLAIN_PERIOD + PLAIN_FULL_STOP
PLAIN_LAST = PLAIN_BRACKET + PLAIN_NUMBER


def _either(c: Column, every: Callable[[Column], Column], printable: Callable[[Column], Column]) -> Column:
    """``printable`` is what is left of ``every`` for a line of printable ASCII, as most lines are: rules that look
    for other signs are not run there."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike("[^ -~]"), every(c)).otherwise(printable(c))


def line(c: Column) -> Column:
    """The whole chain for one line; null is empty."""
    ascii_ = lambda x: F.when(F.contains(x, F.lit("SEQ")), apply(x, FIELD_CODE)).otherwise(x)
    return _either(c, lambda x: apply(widths(apply(x, FIRST)), LAST), lambda x: apply(ascii_(x), FIGURE + COLLAPSE + BRACKET_NUMBER + NUMBER_LINE))


def line_sql(expr: str) -> str:
    return sql(widths_sql(sql(f"coalesce({expr}, '')", FIRST)), LAST)


def plain_line(c: Column) -> Column:
    return _either(c, lambda x: apply(widths(apply(x, PLAIN_FIRST)), PLAIN_LAST), lambda x: apply(x, FIGURE + COLLAPSE + PLAIN_PERIOD + PLAIN_LAST))


def plain_line_sql(expr: str) -> str:
    return sql(widths_sql(sql(f"coalesce({expr}, '')", PLAIN_FIRST)), PLAIN_LAST)


CONVERTER_FIRST: Rules = CONTROLS + [(r"[\x{A0}\x{C2A0}]", " ")] + QUOTES + FIGURE + COLLAPSE


def converter_lines(c: Column) -> Column:
    """The variant used when a document is written: no breaks inside a sentence; gives an array of lines."""
    return F.split(apply(widths(apply(F.coalesce(c, F.lit("")), CONVERTER_FIRST)), PLAIN_LAST), "\n")


def converter_lines_sql(expr: str) -> str:
    return f"string_split({sql(widths_sql(sql(f'coalesce({expr}, {chr(39) * 2})', CONVERTER_FIRST)), PLAIN_LAST)}, chr(10))"


def short_line(c: Column) -> Column:
    """Quotes, blanks and widths only; line structure is left alone."""
    return widths(apply(F.coalesce(c, F.lit("")), SPACES + QUOTES))


def short_line_sql(expr: str) -> str:
    return widths_sql(sql(f"coalesce({expr}, '')", SPACES + QUOTES))


def strip_math(c: Column) -> Column:
    return apply(c, MATH)


def strip_symbols(c: Column) -> Column:
    return apply(c, PUNCTUATION + UNPRINTABLE)


#: A sign that a rule of ``strip_all`` other than that for punctuation can change.
_RARE = r"[^ -~\x{C0}-\x{36F}]"


def strip_all(c: Column) -> Column:
    """Math ranges, then the short normaliser, then punctuation and unprintable characters. Lines of plain Latin
    letters, as most are, have nothing but punctuation to lose."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(_RARE), strip_symbols(short_line(strip_math(c)))).otherwise(apply(c, PUNCTUATION))


def bare(c: Column) -> Column:
    """A line without symbols and blanks."""
    return apply(strip_all(c), [(BLANK + "+", "")])


def strip_all_sql(expr: str) -> str:
    return sql(short_line_sql(sql(f"coalesce({expr}, '')", MATH)), PUNCTUATION + UNPRINTABLE)


def cleanup(c: Column) -> Column:
    """Runs of blanks become one, except beside " - "; lines are trimmed and empty ones go."""
    c = F.regexp_replace(c, r"(?U)(?<!\s-)[^\S\n\r]+(?!-\s)", " ")
    c = F.regexp_replace(c, r"(?Um)^\s+|\s+$", "")
    return F.regexp_replace(c, r"\n+", "\n")


#: Closing bracket or full stop and two blanks end a segmented line.
CLOSED = r"(?s)^.+[)\]>）＞〕】≫》。]  $"


def trim_separator(c: Column) -> Column:
    return F.when(F.length(c) > 3, F.when(c.rlike(CLOSED), F.regexp_replace(c, BLANK + "+$", "")).otherwise(c)).otherwise(c)


def trim_separator_sql(e: str) -> str:
    return f"CASE WHEN length({e}) > 3 AND regexp_matches({e}, {quote(CLOSED)}) THEN regexp_replace({e}, {quote(BLANK + '+$')}, '') ELSE {e} END"


def display_feed(c: Column) -> Column:
    """A line as shown: ended lines stay or lose their blanks, others get a line feed."""
    return F.when((F.length(c) > 3) & c.endswith(".  "), c).when((F.length(c) > 3) & c.rlike(CLOSED), F.regexp_replace(c, BLANK + "+$", "")).otherwise(F.concat(c, F.lit("\n")))


def head(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def safe_substring(c: Column, start: Column, size: Column | None = None) -> Column:
    """Zero-based; a start beyond the text or a negative one gives what is there, never an error."""
    at = F.greatest(start, F.lit(0))
    left = F.greatest(F.length(c) - at, F.lit(0))
    return F.substring(c, at + 1, left if size is None else F.greatest(F.least(size, left), F.lit(0)))
