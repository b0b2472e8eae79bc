"""Characters of symbol fonts and of formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters at which a Symbol font shows Greek capitals and small letters.
SYMBOL_FONT = "ABGDEZHQIKLMNXOPRSTUFCYWabgdezhqiklmnxoprVstujcyw"
SYMBOL_FONT_TO = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρςστυφχψω"
#: What private-use codes U+F020..F07E stand for, in code order.
PRIVATE_TO = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
PRIVATE = "".join(chr(0xF020 + i) for i in range(len(PRIVATE_TO)))
#: The increment sign is shown as a capital delta; all other letters of formulas stay.
_MATH, _MATH_TO = "∆", "Δ"


def from_symbol_font(c: Column) -> Column:
    """Text set in a Symbol font, as Unicode; left-over private-use characters become blanks."""
    return _blank_private(F.translate(c, SYMBOL_FONT + _MATH, SYMBOL_FONT_TO + _MATH_TO))


def plain_text(c: Column) -> Column:
    return _blank_private(F.translate(c, _MATH, _MATH_TO))


def _blank_private(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{F000}-\x{F0FF}]", " ")


def from_symbol_code(code: Column) -> Column:
    """A hexadecimal code of a symbol element, as Unicode: unknown private codes are a blank, other codes stay as written."""
    number = F.when(code.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(code, 16, 10).cast("bigint"))
    known = F.create_map(*[x for i, to in enumerate(PRIVATE_TO) for x in (F.lit(0xF020 + i), F.lit(to))])
    return F.coalesce(F.when(number <= 0xF0FF, F.try_element_at(known, number.cast("int"))), F.when(number.between(0xF000, 0xF0FF), " "), code)


def is_special(c: Column) -> Column:
    """A single character that one of the tables holds."""
    return c.rlike(r"^[\x{391}-\x{3A1}\x{3A3}-\x{3A9}\x{3B1}-\x{3C9}\x{2206}\x{2207}\x{2200}\x{2203}\x{2205}\x{2208}\x{2209}\x{220B}\x{220F}\x{2211}\x{221A}\x{221D}\x{221E}\x{2229}\x{222A}\x{2248}\x{2260}\x{2264}\x{2265}\x{F020}-\x{F07E}]$")
