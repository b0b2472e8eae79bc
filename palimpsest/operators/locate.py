"""Where a matched line stands in a document: patterns, spans, paragraphs, runs.

A line becomes a pattern that forgives blanks around punctuation and between words. All patterns of a
document are looked for at once, by an automaton over the text without blanks; where one may stand it is
matched, in an Arrow function (the engine's regex functions give text, not positions). Paragraph and run
positions both count normalised text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: A line is looked for when it has so many characters or words.
LEAST_CHARS, LEAST_WORDS = 20, 3
# The sign classes of a pattern.
_APOSTROPHE, _QUOTE = "[‘']", '["®™–—]'


def prepared(line: Column) -> Column:
    """Without the leading number; null when too short to look for."""
    body = F.regexp_replace(line, r"^[0-9]+\.?[\t-\r\x85\p{Z}]+", "")
    return F.when((F.length(line) < LEAST_CHARS) & (F.size(F.split(body, " ")) < LEAST_WORDS), F.lit(None)).otherwise(body)


def pattern(line: str) -> str:
    """Regex of a line: words with free blanks between them, punctuation with free blanks around it."""
    words = []
    for word in line.split(" "):
        if not word:
            continue
        made = ""
        for i, c in enumerate(word):
            if c in ",.:;()":
                made += (r"\s*" if c in ".()" else "") + re.escape(c) + (r"\s*" if i + 1 < len(word) else "")
            elif c == "'":
                made += _APOSTROPHE
            elif c == '"':
                made += _QUOTE
            elif "0" <= c <= "9":
                first = i == 0 or not word[i - 1].isdigit()
                last = i + 1 == len(word) or not word[i + 1].isdigit()
                made += r"\s*" * first + c + r"\s*" * last
            else:
                made += re.escape(c)
        words.append(made)
    return r"\s*".join(words)


def spans(line: str | None, text: str | None) -> list[dict]:
    """All (begin, end) places of a line in a text, end inclusive, outer blanks cut off."""
    if not line or not text:
        return []
    out = []
    for m in re.finditer(pattern(line), text):
        b, e = m.span()
        while b < e and text[b].isspace():
            b += 1
        while b < e and text[e - 1].isspace():
            e -= 1
        out.append({"begin": b, "end": e - 1})
    return out


#: Signs that a pattern's apostrophe and quote also stand for.
_ALIKE = {ord("‘"): "'", **dict.fromkeys(map(ord, "®™–—"), '"')}


def folded(text: str) -> tuple[str, np.ndarray]:
    """The text without blanks, signs that patterns take for one another made one, and each sign's place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.flatnonzero(~np.isin(codes, _BLANKS))
    return codes[seen].tobytes().decode("utf-32-le", "surrogatepass").translate(_ALIKE), seen


_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def all_spans(lines: list[str | None], text: str | None) -> list[list[dict]]:
    """``spans`` of each line. The text is walked over once for all of them; a pattern is made and matched only
    where the line stands but for blanks."""
    import ahocorasick

    out: list[list[dict]] = [[] for _ in lines]
    keys = [folded(line)[0] if line else "" for line in lines]
    if not text or not any(keys):
        return out
    automaton = ahocorasick.Automaton()
    for key in {k for k in keys if k}:
        automaton.add_word(key, key)
    automaton.make_automaton()
    body, place = folded(text)
    starts: dict[str, list[int]] = {}
    for last, key in automaton.iter(body):
        starts.setdefault(key, []).append(int(place[last - len(key) + 1]))
    for line, key, found in zip(lines, keys, out):
        free = 0
        made = re.compile(pattern(line)) if key in starts else None
        for at in starts.get(key, ()):
            if at < free:
                continue
            before = at
            while before > free and text[before - 1].isspace():
                before -= 1
            hit = made.match(text, before) or made.match(text, at)
            if hit:
                b, e = hit.span()
                free = e
                while text[b].isspace():
                    b += 1
                while text[e - 1].isspace():
                    e -= 1
                found.append({"begin": b, "end": e - 1})
    return out


_SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])


@F.pandas_udf(ArrayType(ArrayType(_SPAN)))
def all_spans_arrow(lines: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([all_spans(list(a), b) for a, b in zip(lines, text)])


#: Patterns of one document that are looked for in one go.
PATTERNS = 2_000


def spans_in(patterns: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """``patterns(doc_id, key..., search)`` in ``texts(doc_id, text)`` -> ``(doc_id, key..., search, spans)``. A document
    with very many patterns is read once for each ``PATTERNS`` of them; a null search has no spans."""
    no = F.row_number().over(W.partitionBy("doc_id").orderBy(*key))
    each = patterns.select("doc_id", F.floor((no - 1) / PATTERNS).alias("part"), F.struct(*key, "search").alias("p"))
    listed = each.groupBy("doc_id", "part").agg(F.collect_list("p").alias("ps"))
    both = listed.join(texts.select("doc_id", "text"), "doc_id").withColumn("spans", all_spans_arrow(F.transform("ps", lambda p: p["search"]), F.col("text")))
    return both.select("doc_id", F.inline(F.arrays_zip("ps", "spans"))).select("doc_id", "ps.*", "spans")


@F.pandas_udf(ArrayType(_SPAN))
def spans_arrow(line: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([spans(a, b) for a, b in zip(line, text)])


def paragraph_offsets(lines: DataFrame, id_col: str, gap: int = 1) -> DataFrame:
    """Start and inclusive end of every line in the text that joins them, ``gap`` characters apart."""
    w = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("text")
    end = F.sum(size + gap).over(w)
    return lines.select(id_col, "line_no", "text", (end - size - gap).cast("int").alias("start"), (end - gap - 1).cast("int").alias("end"))


def paragraph_at(spans: DataFrame, paragraphs: DataFrame, id_col: str) -> DataFrame:
    """The paragraph with the greatest start at or before each span's begin (as-of): one ordered pass
    over both tables' rows of a document, no pairs."""
    p = paragraphs.select(id_col, F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("line_no").alias("para"), F.lit(None).cast("int").alias("span_no"))
    s = spans.select(id_col, F.col("begin").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("para"), "span_no")
    w = W.partitionBy(id_col).orderBy("at", "kind", "para").rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(s).withColumn("para", F.last("para", ignorenulls=True).over(w))
    return both.filter("kind = 1").select(id_col, "span_no", F.col("at").alias("begin"), F.col("para").alias("line_no"))


def overlapping(spans: DataFrame, paragraphs: DataFrame, id_col: str, bucket: int = 1024) -> DataFrame:
    """Every paragraph that a span touches, with the part of it (inclusive offsets in the paragraph).

    Positions are bucketed, so the range join is an equi-join; a pair is made in the bucket where the
    later of the two begins, once."""
    s = spans.select(id_col, "span_no", "begin", F.col("end").alias("stop"), F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor(F.greatest("begin", "end") / bucket))).alias("b"))
    p = paragraphs.filter("end >= start").select(id_col, "line_no", "start", F.col("end").alias("last"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("b"))
    hit = s.join(p, [id_col, "b"]).filter((F.col("begin") <= F.col("last")) & (F.col("stop") >= F.col("start")) & (F.floor(F.greatest("begin", "start") / bucket) == F.col("b")))
    return hit.select(id_col, "span_no", "line_no", (F.greatest("begin", "start") - F.col("start")).alias("from"), (F.least("stop", "last") - F.col("start")).alias("to"))


def runs_of(parts: DataFrame, runs: DataFrame, id_col: str) -> DataFrame:
    """Parts of paragraphs mapped to runs: ``runs(id, line_no, run_no, tx_start, tx_len, orig_start)``.
    Gives the piece of each run in the run's own offsets, for splitting it before, inside and after."""
    hit = parts.join(runs, [id_col, "line_no"]).filter((F.col("from") < F.col("tx_start") + F.col("tx_len")) & (F.col("to") >= F.col("tx_start")))
    lo = F.greatest(F.col("from") - F.col("tx_start"), F.lit(0))
    hi = F.least(F.col("to") - F.col("tx_start"), F.col("tx_len") - 1)
    return hit.select(id_col, "span_no", "line_no", "run_no", (F.col("orig_start") + lo).alias("run_from"), (F.col("orig_start") + hi).alias("run_to"))


def split_run(text: Column, lo: Column, hi: Column) -> Column:
    """A run cut into what stands before, inside and after the inclusive range."""
    n = F.length(text)
    return F.struct(F.substring(text, F.lit(1), lo).alias("before"), F.substring(text, lo + 1, F.greatest(hi - lo + 1, F.lit(0))).alias("inside"), F.substring(text, hi + 2, F.greatest(n - hi - 1, F.lit(0))).alias("after"))


def aligned(normal: str, raw: str, begin: int, end: int) -> tuple[int, int]:
    """Inclusive offsets in ``normal`` carried over to ``raw``, both walked together over their letters and
    digits; the whole of ``raw`` when they differ, (-1, -1) when out of range."""
    if begin < 0 or end >= len(normal) or begin > end:
        return -1, -1
    a = [i for i, c in enumerate(normal) if c.isalnum()]
    b = [i for i, c in enumerate(raw) if c.isalnum()]
    if [normal[i] for i in a] != [raw[i] for i in b]:
        return 0, len(raw) - 1
    inside = [k for k, i in enumerate(a) if begin <= i <= end]
    return (b[inside[0]], b[inside[-1]]) if inside else (-1, -1)


def located(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """``patterns(doc_id, pattern_no, line, rate)`` in ``texts(doc_id, text)`` -> spans and whether any was found."""
    found = spans_in(patterns.withColumn("search", prepared(F.col("line"))), texts, ["pattern_no", "rate"])
    return found.select("doc_id", "pattern_no", "rate", "spans", F.when(F.col("search").isNull(), "skipped").when(F.size("spans") > 0, "found").otherwise("not found").alias("status"))


#: So many leading characters of a piece are looked for when places are found in order.
HEAD = 120


def occurrences(heads: list[str], texts: list[str]) -> dict[str, tuple[list[int], list[int]]]:
    """``head -> (numbers of texts, offsets)`` of all its places, in order. One pass of an automaton over the
    texts finds all heads at once, so a head that is nowhere costs nothing."""
    import ahocorasick

    wanted = {h for h in heads if h}
    found: dict[str, tuple[list[int], list[int]]] = {h: ([], []) for h in wanted}
    if not wanted:
        return found
    automaton = ahocorasick.Automaton()
    for h in wanted:
        automaton.add_word(h, h)
    automaton.make_automaton()
    for number, text in enumerate(texts):
        for last, h in automaton.iter(text):
            numbers, offsets = found[h]
            numbers.append(number)
            offsets.append(last - len(h) + 1)
    return found


def forward_paragraphs(pieces: list[str], paragraphs: list[str]) -> list[int]:
    """The paragraph of each piece, found by the piece's head in the order of the text (-1 before any is found; a
    piece that is not found stays with the one before). Behind a piece that ends a sentence, the search goes
    on in the next paragraph."""
    heads = [p.strip()[:HEAD] for p in pieces]
    where = occurrences(heads, paragraphs)
    out, least = [], 0
    for piece, head in zip(pieces, heads):
        numbers = where[head][0] if head else []
        k = bisect_left(numbers, least)
        out.append(numbers[k] if k < len(numbers) else out[-1] if out else -1)
        if k < len(numbers) and piece.rstrip().endswith("."):
            least = numbers[k] + 1
    return out


def forward_lines(pieces: list[str], lines: list[str]) -> list[int]:
    """The line of each piece: its head's first place behind the piece found last (-1: none). What is left of
    a line that a piece reaches to its end is not looked at again."""
    bare = [x.strip().strip(".") for x in lines]
    heads = [p.strip().strip(".")[:HEAD] for p in pieces]
    where = {h: list(zip(*w)) for h, w in occurrences(heads, bare).items()}
    out, least = [], (0, 0)
    for piece, head in zip(pieces, heads):
        places = where.get(head, [])
        k = bisect_left(places, least)
        if k == len(places):
            out.append(-1)
            continue
        line, at = places[k]
        out.append(line)
        behind = at + len(piece)
        least = (line, behind) if behind < len(bare[line]) else (line + 1, 0)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def forward_paragraphs_arrow(pieces: pd.Series, paragraphs: pd.Series) -> pd.Series:
    return pd.Series([forward_paragraphs(list(a), list(b)) for a, b in zip(pieces, paragraphs)])


@F.pandas_udf(ArrayType(IntegerType()))
def forward_lines_arrow(pieces: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([forward_lines(list(a), list(b)) for a, b in zip(pieces, lines)])
