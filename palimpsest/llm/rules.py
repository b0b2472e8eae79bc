"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 512
WINDOW = 5


class Measures:
    """Lazily computed measures of one text; each is computed at most once."""

    __slots__ = ("text", "got")

    def __init__(self, text: str | None):
        self.text, self.got = text or "", {}

    def __getattr__(self, name: str):
        got = self.got
        if name not in got:
            got[name] = getattr(self, "_" + name)()
        return got[name]

    def _bytes(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def _words(self) -> list[bytes]:
        return self.bytes.split()

    def _ids(self) -> np.ndarray:
        """Each word as the number of its first place among the distinct words."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.uint64, len(self.words))

    def _n_words(self) -> int:
        return len(self.words)

    def _count(self, drop: bytes) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, drop))

    def _word_chars(self) -> int:
        return len(self.text) - self._count(b" \t\n\v\f\r")

    def _n_symbols(self) -> int:
        return self._count(b"#*$%&|<>")

    def _n_dup_lines(self) -> int:
        lines = self.text.split("\n")
        if len(lines) == len(set(lines)):
            return 0
        lines = [x for x in lines if x.strip(" \t\n\v\f\r")]
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        return repeat_words(self.words, self.ids)

    def _n_upper(self) -> int:
        return self._count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def _n_letters(self) -> int:
        """Letters of ASCII and all characters beyond it."""
        return len(self.text) - self._count(_NO_LETTER)

    def _n_shouts(self) -> int:
        return self.text.count("!")

    def _top_word(self) -> int:
        return int(np.bincount(self.ids.astype(np.int64)).max()) if self.n_words else 0


_NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())


def repeat_words(words: list[bytes], ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more in the text, its first place included."""
    n = len(words) - window + 1
    if n < 2 or int(ids.max()) == len(words) - 1:
        return 0
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = (mixed + ids[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    s = np.sort(mixed)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    # Equal mixes are confirmed word by word.
    at: dict[tuple, list[int]] = {}
    for p in np.flatnonzero(np.isin(mixed, again)).tolist():
        at.setdefault(tuple(words[p : p + window]), []).append(p)
    hit = np.zeros(len(words) + 1, np.int64)
    for places in at.values():
        if len(places) > 1:
            hit[places] += 1
            hit[[p + window for p in places]] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: The base rules and the method's own. A text is kept when none rejects it.
BASE = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
)
OWN = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("shouting", lambda m: 10 * m.n_shouts > 3 * m.n_words),
    Rule("upper_case", lambda m: 2 * m.n_upper > m.word_chars),
    Rule("duplicate_lines", lambda m: 100 * m.n_dup_lines > 40 * max(1, m.text.count("\n") + 1)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 30 * m.n_words),
    Rule("few_letters", lambda m: 10 * m.n_letters < 5 * m.word_chars),
    Rule("one_word", lambda m: m.n_words >= 20 and 10 * m.top_word > 4 * m.n_words),
)
RULES = BASE + OWN


def estimate(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected), each rule measured by itself on the sample."""
    out = []
    for r in rules:
        began = time.perf_counter()
        rejected = sum(r.rejects(Measures(t)) for t in texts)
        out.append((r.name, (time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts))))
    return out


def plan(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by falling rejections per cost. Order changes the work, never the verdict."""
    seen = {name: (-rejected / (cost + 1e-9), cost) for name, cost, rejected in estimate(texts, rules)}
    return tuple(sorted(rules, key=lambda r: seen[r.name]))


#: Bytes of the longest text in the sample, which so is at most SAMPLE_ROWS times as large (16 MB).
SAMPLE_BYTES = 1 << 15


def sample(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[str | None]:
    """At most ``rows`` texts of at most ``SAMPLE_BYTES`` each, drawn by a hash of the row's number from all rows,
    only to order the rules: a poor sample costs time, not correctness."""
    drawn = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("draw")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    return [r[0] for r in drawn.orderBy("draw").limit(rows).collect()]


def _verdict(m: Measures, order: tuple[Rule, ...]) -> bool:
    return not any(r.rejects(m) for r in order)


def passing(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept. The cascade stops at a text's first
    rejection. Null texts have no words and go; an empty table stays empty; repeated rows share a fate."""
    order, at = plan(sample(docs, text_col, rows)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_verdict(Measures(t), order) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` for
    each row. The five measures are always reported; the method's own rules run only on texts that pass
    the base. Null is an empty text; further columns are ignored."""
    order = plan(sample(docs, text_col, rows), OWN)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                m = Measures(t)
                failed = any(r.rejects(m) for r in BASE)
                rows.append([getattr(m, n) for n in names] + [failed, not failed and _verdict(m, order)])
            cols = list(zip(*rows)) or [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.bool_()) for c in cols[5:]]], names=["doc_id", *names, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(n + ' bigint' for n in names)}, base_failed boolean, kept boolean")


def op5_sql() -> str:
    """DuckDB: base measures and verdict; the method's own rules restated."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, t, ws, ls, CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [] END AS gs FROM w),
u AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM u) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
m AS (SELECT g.doc_id, t, len(ws) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(p.n, 0) AS n_repeat_words,
        length(t) - length(replace(t, '!', '')) AS shouts,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper,
        length(t) - length(replace(t, chr(10), '')) + 1 AS lines,
        length(regexp_replace(t, '[\x00-@\x5B-`\x7B-\x7F]', '', 'g')) AS letters,
        coalesce(top.c, 0) AS top
      FROM g LEFT JOIN p USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * shouts > 3 * n_words OR 2 * upper > word_chars
    OR 100 * n_dup_lines > 40 * lines OR word_chars < 2 * n_words OR word_chars > 30 * n_words
    OR 10 * letters < 5 * word_chars OR (n_words >= 20 AND 10 * top > 4 * n_words)) AS kept
FROM b"""
