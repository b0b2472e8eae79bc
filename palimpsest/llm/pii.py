"""Personal data: exact base patterns, and identifiers in disguise found through transducers.

A transducer rewrites a text and remembers, for every output character, the source span it came
from. Three run in turn: look-alike and full-width characters become ASCII and invisible ones
vanish; runs of spelled digits (English, German, French, Spanish) become digits; bracketed or
spelled "at"/"dot" become signs where the words around them make an address. The base patterns
then run on the rewritten text, and what they find is mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9][ .-]?[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of ``KINDS``."""
    found = []
    if "@" in text:
        found += [(s, e, "email") for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            # A part of more than three digits is at most 255 only with leading zeros.
            found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


class Mapped:
    """A rewritten text whose runs of characters remember their source spans.

    ``at[i]`` is where run i begins in ``text``; ``src[i]`` its source span. Runs of copied
    characters keep a one-to-one offset; rewritten ones map as a whole."""

    __slots__ = ("text", "at", "src", "plain")

    def __init__(self, text: str):
        self.text, self.at, self.src, self.plain = text, [0], [(0, len(text))], [True]

    def source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        lo = self.src[i][0] + (start - self.at[i]) * self.plain[i]
        hi = self.src[j][0] + (end - self.at[j]) if self.plain[j] else self.src[j][1]
        return lo, hi

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply disjoint ascending (start, end, replacement) edits of the present text."""
        if not edits:
            return self
        out, parts, pos, size = Mapped(""), [], 0, 0
        out.at, out.src, out.plain = [], [], []

        def add(text: str, src: tuple[int, int], plain: bool) -> None:
            nonlocal size
            if text:
                out.at.append(size)
                out.src.append(src)
                out.plain.append(plain)
                parts.append(text)
                size += len(text)

        def copy(lo: int, hi: int) -> None:
            i = bisect_right(self.at, lo) - 1
            while lo < hi:
                nxt = min(hi, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                if self.plain[i]:
                    s = self.src[i][0] + lo - self.at[i]
                    add(self.text[lo:nxt], (s, s + nxt - lo), True)
                else:
                    add(self.text[lo:nxt], self.src[i], False)
                lo, i = nxt, i + 1

        for lo, hi, new in edits:
            copy(pos, lo)
            add(new, self.source(lo, hi), False)
            pos = hi
        copy(pos, len(self.text))
        out.text = "".join(parts)
        return out


#: Look-alikes of ASCII letters (Cyrillic, Greek), and other digits and signs.
_ALIKE = str.maketrans(
    "аеорсухіјѕԁӏАВЕКМНОРСТУХІЈЅαοιυνρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。｡∙‐‑‒–−﹢﹫",
    "aeopcyxijsdlABEKMHOPCTYXIJSaoiuvpkABEZHIKMNOPTYX....-----+@",
)
_ALIKE |= {0xFF01 + i: 0x21 + i for i in range(94)}
_ALIKE |= {zero + i: 48 + i for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_ALIKE |= {0x2007: 0x20, 0x00A0: 0x20, 0x202F: 0x20, 0x3000: 0x20, 0x2009: 0x20}
_ALIKE |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)}
_ODD = re.compile("[" + re.escape("".join(map(chr, _ALIKE))) + "]")

#: Digit words of four languages.
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_DOT_WORD = "(?:dot|punkt|point|punto)"
#: Digit words and digits, joined by blanks, dashes or "dot".
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:plus|\+)[ -]*+)?(?:{_WORD}|[0-9]++)(?!\w)(?:(?:[ -]++(?!{_DOT_WORD}\b)|[ ]?[.][ ]?|[ ]++{_DOT_WORD}[ ]++)(?:{_WORD}|[0-9]++)(?!\w))++")
_TOKEN = re.compile(rf"(?i){_WORD}|[0-9]+|{_DOT_WORD}|plus|\+|[ .-]+")
#: Digit words that a run needs, and how many when a plus sign opens it.
LEAST_WORDS, LEAST_AFTER_PLUS = 4, 2
_AT = r"(?:[ ]?[\[\(\{<][ ]?(?:at|@|arroba|arobase|ät)[ ]?[\]\)\}>][ ]?|[ ]@[ ]|[ ](?:at|arroba|arobase)[ ]|@)"
_DOT = r"(?:[ ]?[\[\(\{<][ ]?(?:dot|\.|punkt|point|punto)[ ]?[\]\)\}>][ ]?|[ ](?:dot|punkt|punto|point)[ ]|\.)"
_BRACKETED = re.compile(r"[\[({<] ?(?:at|@|arroba|arobase|ät|dot|\.|punkt|point|punto) ?[\])}>]")
_LOOSE = (" dot ", " punkt ", " punto ", " point ", " @ ")
_AT_1, _DOT_1 = re.compile("(?i)" + _AT), re.compile("(?i)" + _DOT)
_HIDDEN_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]++(?:{_DOT}[0-9]++){{3}}")
_NAME, _LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"), re.compile("[A-Za-z0-9-]+")


def _alike(m: Mapped) -> Mapped:
    """Nothing of Latin-1 changes but two kinds of blank."""
    try:
        m.text.encode("latin-1")
        if "\xa0" not in m.text and "\xad" not in m.text:
            return m
    except UnicodeEncodeError:
        pass
    if not _ODD.search(m.text):
        return m
    return m.rewrite([(x.start(), x.end(), x[0].translate(_ALIKE)) for x in _ODD.finditer(m.text)])


def _spelled(low: str) -> bool:
    """Digit words stand close enough together for a run, or after a plus sign."""
    at = [i for i, w in enumerate(low.replace("-", " ").replace(".", " ").replace("+", " ").split()) if w in _SPELLED]
    return any(b - a <= 64 for a, b in zip(at, at[LEAST_WORDS - 1 :])) or len(at) >= LEAST_AFTER_PLUS and ("+" in low or "plus" in low)


def _digits(m: Mapped, low: str) -> Mapped:
    """Runs of one digit word over and over, as lists of nulls are, stay."""
    if not _spelled(low):
        return m
    edits = []
    for run in _SPELLED_RUN.finditer(m.text):
        tokens = [(t.start() + run.start(), t.end() + run.start(), t[0].lower()) for t in _TOKEN.finditer(run[0])]
        words = [t for _, _, t in tokens if t in _SPELLED]
        if len(words) < (LEAST_AFTER_PLUS if tokens[0][2] in ("plus", "+") else LEAST_WORDS) or len(set(words)) < 2:
            continue
        for k, (lo, hi, t) in enumerate(tokens):
            if t in _SPELLED:
                edits.append((lo, hi, _SPELLED[t]))
            elif t == "plus":
                edits.append((lo, hi, "+"))
            elif t in ("dot", "punkt", "point", "punto"):
                edits.append((lo, hi, "."))
            elif not t.isdigit() and t != "+":  # a separator
                near = [tokens[i][2] for i in (k - 1, k + 1) if 0 <= i < len(tokens)]
                dotted = "." in t or any(x in ("dot", "punkt", "point", "punto") for x in near)
                edits.append((lo, hi, "." if "." in t else "" if dotted or any(x in _SPELLED or x in ("plus", "+") for x in near) else " "))
    return m.rewrite(edits)


def _signs(m: Mapped, low: str) -> Mapped:
    """Around each sign that may stand for "at", the names that disguised or plain dots string together."""
    if not any(x in low for x in _LOOSE) and not _BRACKETED.search(low):
        return m
    text = m.text
    dots = [(d.start(), d.end()) for d in _DOT_1.finditer(text)]
    before, after = {e: s for s, e in dots}, dict(dots)
    found, floor = [], 0
    for at in _AT_1.finditer(text):
        own, lo, hi = [], at.start(), at.end()
        while True:  # to the left, not into the address before
            run = lo
            while run > floor and text[run - 1] in _NAME:
                run -= 1
            if run == lo:
                lo = own.pop()[1] if own else None
                break
            lo = run
            if lo not in before or before[lo] < floor:
                break
            own.append((before[lo], lo))
            lo = before[lo]
        label, domain = _LABEL.match(text, hi), []
        while label:
            hi = label.end()
            dot = (hi, after[hi]) if hi in after else None
            label = _LABEL.match(text, dot[1]) if dot else None
            if label:
                domain.append(dot)
        if lo is None or not domain:
            continue
        # Plain words around a bare "at" are an address only with all dots of the domain in disguise.
        signs = [at.span(), *own, *domain]
        if any(text[a:b] not in ("@", ".") for a, b in signs) and (not at[0].strip().isalpha() or all(text[a:b] != "." for a, b in domain)):
            found.append((lo, hi, sorted((a, b, "@" if a == at.start() else ".") for a, b in signs)))
            floor = hi
    for x in _HIDDEN_IP.finditer(text):
        own = [(d.start() + x.start(), d.end() + x.start(), ".") for d in _DOT_1.finditer(x[0])]
        if any(text[a:b] != "." for a, b, _ in own):
            found.append((x.start(), x.end(), own))
    edits, end = [], -1
    for lo, hi, own in sorted(found, key=lambda s: s[:2]):
        if lo >= end:
            edits += [e for e in own if text[e[0] : e[1]] != e[2]]
            end = hi
    return m.rewrite(edits)


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a whole text; null is empty. Added spans never overlap a base
    span, nor one another."""
    text = text or ""
    base = base_spans(text)
    m = _alike(Mapped(text))
    low = m.text.lower()
    m = _signs(_digits(m, low), low)
    if m.text is text or len(m.at) == 1 and m.plain[0]:
        return base, base
    added, end, k = [], 0, 0
    taken = sorted((s, e) for s, e, _ in base)
    reach = list(accumulate((e for _, e in taken), max))  # furthest end of the base spans so far
    for s, e, kind in base_spans(m.text):
        lo, hi = m.source(s, e)
        while k < len(taken) and taken[k][0] < hi:
            k += 1
        if lo >= end and (not k or reach[k - 1] <= lo):
            added.append((lo, hi, kind))
            end = hi
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, pos = [], 0
    for s, e, kind in spans(text)[1]:
        if s >= pos:
            out += [text[pos:s], f"[{kind.upper()}]"]
            pos = e
        else:
            pos = max(pos, e)
    return "".join(out) + text[pos:] if out else text


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, found)`` for each row: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts give empty arrays; repeated rows and null ids are kept as they are; an
    empty table gives an empty table; further columns, whatever their names, are ignored."""
    one = "array<struct<kind:string,start:bigint,`end`:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            both = [spans(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "base", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base {one}, found {one}")


def redacted(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its texts redacted and, where that column exists, the character count renewed.
    All other columns and all rows are kept; null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType)) if n_chars_col in names else out


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of what ``find`` returned."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count("base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("found").alias("spans"),
        *[count("found", k).alias(f"all_{k}") for k in KINDS],
    )
