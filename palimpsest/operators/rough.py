"""Rough prefilter: blocks of source lines against overlapping blocks of target lines.

A block of R source lines passes a target block of 50 + R lines when enough of at most twenty of
its words are found there one after another. Words are taken at even distances, so the filter
gives the same answer each time. It is lossy; the exact join does without it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.normalize import let

STRIDE, WORDS = 50, 20
#: Source blocks and documents that meet in one row.
GROUP, BUNCH = 256, 64
#: Target blocks that are walked at once, up to so many signs; bytes that are looked at at once.
AT_ONCE, SIGNS, STEP = 64, 1 << 17, 1 << 14
#: Bytes of a word that is looked for together with others.
LONG = 32
_LOW = (1 << 32) - 1


def source_blocks(lines: DataFrame, r: int) -> DataFrame:
    """``(src_id, first, last, words)``: at most ``WORDS`` words of each block of ``r`` lines."""
    block = lines.withColumn("block", F.floor(F.col("line_no") / r)).groupBy("src_id", "block").agg(
        F.max("line_no").alias("last"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("line_no", "idx"))).alias("ls")
    )
    words = F.split(F.concat(F.array_join(F.transform("ls", lambda x: x["idx"]), " "), F.lit(" ")), " ")
    return block.select("src_id", (F.col("last") - F.col("n")).alias("first"), "last", words.alias("all")).select("src_id", "first", "last", sampled(F.col("all")).alias("words"))


def sampled(words: Column) -> Column:
    n = F.least(F.size(words), F.lit(WORDS))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.floor(i * F.size(words) / n) + 1).cast("int")))


def target_blocks(lines: DataFrame, r: int) -> DataFrame:
    """``(doc_id, start, block)``: lines [start, start + STRIDE + r) joined by blanks, each line in one or more blocks."""
    k = F.floor(F.col("line_no") / STRIDE)
    back = F.greatest(F.lit(0), F.ceil((F.col("line_no") - STRIDE - r + 1) / STRIDE))
    spread = lines.select("doc_id", "line_no", "text", F.explode(F.sequence(back, k)).alias("k"))
    ls = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    block = spread.groupBy("doc_id", (F.col("k") * STRIDE).cast("int").alias("start")).agg(ls.alias("ls"))
    return block.select("doc_id", "start", F.concat(F.array_join(F.transform("ls", lambda x: x["text"]), " "), F.lit(" ")).alias("block"))


class Walk:
    """Blocks of sampled words, to be walked through many target blocks at once.

    The words are a trie over bytes, as one table of a row for each state, so all places of all words in a text are
    found in as many steps as the longest word has bytes, and a walk looks its next place up among them. Words beyond
    ``LONG`` bytes, which would make the table large, are looked for one by one."""

    def __init__(self, blocks: list[list[str]]):
        number = {"": 0}
        for w in (w for b in blocks for w in b):
            number.setdefault(w, len(number))
        self.width, self.long, ends, edges = len(number), {}, {}, [{}]
        for w, k in number.items():
            if len(code := w.encode()) > LONG:
                self.long[code] = k
                continue
            state = 0
            for c in code:
                to = edges[state].setdefault(c, len(edges))
                if to == len(edges):
                    edges.append({})
                state = to
            ends[state] = k
        self.ends = np.zeros(len(edges), "int32")
        self.ends[list(ends)] = list(ends.values())
        self.sign, used = np.zeros(256, "int32"), sorted({c for e in edges for c in e})
        self.sign[used] = np.arange(1, len(used) + 1)
        self.signs = len(used) + 1
        self.to = np.zeros(len(edges) * self.signs, "int32")
        for state, e in enumerate(edges):
            for c, to in e.items():
                self.to[state * self.signs + self.sign[c]] = to
        one = self.to[: self.signs]
        self.ends_one, self.two = self.ends[one], self.to.reshape(-1, self.signs)[one]
        self.two[one == 0] = 0
        self.two = self.two.ravel()
        self.size = np.array([len(b) for b in blocks], "int32")
        self.words = np.zeros((max(self.size, default=0), len(blocks)), "int32")
        for k, b in enumerate(blocks):
            self.words[: len(b), k] = [number[w] for w in b]
        inside = np.arange(len(self.words))[:, None] < self.size
        self.held, self.blank = inside & (self.words > 0), inside & (self.words == 0)

    def _places(self, blocks: list[str], sizes: np.ndarray) -> np.ndarray:
        """``(block * width + word) << 32 | place`` of each word in each block, in order."""
        text = " ".join(blocks).encode()  # no word holds a blank, so none is found across two blocks
        signs = np.frombuffer(text + b" " * LONG, "uint8")
        code, starts, words = self.sign[signs], [], []

        def note(start: np.ndarray, word: np.ndarray) -> None:
            some = np.flatnonzero(word > 0)
            starts.append(start[some])
            words.append(word[some])

        for low in range(0, len(text), STEP):
            near = code[low : min(low + STEP, len(text)) + 1]
            one, edge = self.ends_one[near[:-1]], near[:-1] * self.signs
            edge += near[1:]
            state = self.two[edge]
            note(np.arange(low, low + len(one)), one)
            at = np.flatnonzero(state > 0)
            state, start, at = state[at], at + low, at + low + 2
            while len(at):
                note(start, self.ends[state])
                state *= self.signs
                state += code[at]
                state = self.to[state]
                goes = np.flatnonzero(state > 0)
                state, start, at = state[goes], start[goes], at[goes] + 1
        for w, k in self.long.items():
            at = text.find(w)
            while at >= 0:
                starts.append(np.array([at]))
                words.append(np.array([k]))
                at = text.find(w, at + 1)
        if not starts:
            return np.zeros(0, "int64")
        start, begins = np.concatenate(starts), np.cumsum(sizes + 1) - sizes - 1
        if len(text) > begins[-1] + sizes[-1]:  # by signs, not bytes
            start = np.cumsum(signs & 0xC0 != 0x80, dtype="int32")[start] - 1
        row = np.repeat(np.arange(len(blocks), dtype="int32"), sizes + 1)[start]
        places = (np.concatenate(words) + row * self.width).astype("int64") << 32
        places += start - begins[row]
        places.sort()
        return places

    def _possible(self, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pairs whose words are there often enough at all, or so near the end that a walk could stop there."""
        last = last[:, self.words]
        enough = True
        for n in (WORDS // 2 + 2, WORDS):
            n = min(n, len(self.words))
            there = ((last[:, :n] >= 0) & self.held[:n] | self.blank[:n]).sum(axis=1, dtype="int32")
            enough &= there * 2 >= np.minimum(self.size, n) - 1
        ends = np.where(self.held, last, -1).max(axis=1, initial=-1) + 1 + self.blank.sum(axis=0)
        return np.flatnonzero(enough | (ends >= sizes[:, None]))

    def passing(self, blocks: list[str]) -> np.ndarray:
        """Which of the blocks of words (columns) pass in which of ``blocks`` (rows): each word must be found behind
        the one before to count, and a word without one stays where it is."""
        out = np.zeros((len(blocks), len(self.size)), bool)
        sizes = np.array([len(b) for b in blocks], "int64")
        places = self._places(blocks, sizes)
        last = np.full(len(blocks) * self.width, -1, "int32")
        last[places >> 32] = places & _LOW
        row, col = np.divmod(self._possible(last.reshape(len(blocks), -1), sizes), len(self.size))
        last[:: self.width] = np.iinfo("int32").max
        pos, hits = np.zeros(len(row), "int64"), np.zeros(len(row), "int32")
        for i, words in enumerate(self.words):
            word = words[col]
            cell = row * self.width + word
            hit = last[cell] >= pos
            hits += hit
            some = np.flatnonzero(hit & (word > 0))
            behind = pos + (word == 0)
            behind[some] = (places[np.searchsorted(places, cell[some] << 32 | pos[some])] & _LOW) + 1
            pos = behind
            end = self.size[col] == i + 1
            fails = (end | (i > WORDS // 2)) & (hits * 2 < i)
            passes = ~fails & (end | (sizes[row] <= pos))
            out[row[passes], col[passes]] = True
            goes = np.flatnonzero(~(fails | passes))
            if len(goes) < len(row):
                row, col, pos, hits = row[goes], col[goes], pos[goes], hits[goes]
        return out


def passing(blocks: list[list[str]], block: str) -> list[int]:
    """Which of ``blocks`` of sampled words pass in ``block``."""
    return np.flatnonzero(Walk(blocks).passing([block])[0]).tolist()


class Group:
    """Source blocks of one row, and which of them mark which line of which source."""

    def __init__(self, text: str):
        words, marks = [], {}
        for source, unit in enumerate(text.split("\n\n")):
            for line in unit.split("\n"):
                first, last, *sample = line.split(" ")
                for n in range(int(first), int(last) + 1):
                    marks.setdefault((source, n), []).append(len(words))
                words.append(sample)
        self.walk = Walk(words)
        self.source, self.line = np.array(list(marks)).T
        self.blocks = np.array([k for ks in marks.values() for k in ks])
        self.begins = np.cumsum([0] + [len(ks) for ks in marks.values()])[:-1]

    def marked(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``docs``, which are given as their target blocks, and of marked lines."""
        every = [b for d in docs for b in d]
        begins = np.cumsum([0] + [len(d) for d in docs])[:-1]
        parts, low, size = [], 0, 0
        for k, b in enumerate(every, 1):
            size += len(b)
            if k == len(every) or k - low == AT_ONCE or size + len(every[k]) > SIGNS:
                parts.append(self.walk.passing(every[low:k]))
                low, size = k, 0
        passed = np.logical_or.reduceat(np.concatenate(parts), begins)
        return np.nonzero(np.logical_or.reduceat(passed[:, self.blocks], self.begins, axis=1))


def cut(texts: list[str], r: int) -> list[str]:
    """The blocks of ``target_blocks`` of one document. It may have come as more than one row; its lines then stand
    together by their numbers."""
    lines = [t.split("\n") for t in texts]
    if len(lines) == 1:
        numbers, lines = range(len(lines[0])), lines[0]
    else:
        numbers, lines = zip(*sorted((n, x) for t in lines for n, x in enumerate(t)))
    at = lambda n: bisect_left(numbers, n)
    return [" ".join(lines[at(n) : at(n + STRIDE + r)]) + " " for n in range(0, numbers[-1] + 1, STRIDE)]


def rough_lines(src: DataFrame, tgt: DataFrame, r: int) -> DataFrame:
    """``(src_id, doc_id, line_no)`` marked by passing blocks, each once. A block also marks the line before it.
    ``tgt(doc_id, lines)`` has whole documents.

    Documents go by bunches to the source blocks by groups, all rows of one document to one bunch and all blocks that
    mark a line to one group, so nothing is made twice. Long sources are cut into stretches of lines for that; the
    block between two is looked at for both."""
    from .matching import BATCH_BYTES, Kept

    kept = Kept()
    tgt.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    span = r * GROUP
    of = lambda c: F.floor((F.col(c) + 1) / span)
    blocks = source_blocks(src, r).withColumn("stretch", F.explode(F.sequence(of("first"), of("last"))))
    own = F.greatest("first", F.col("stretch") * span - 1), F.least("last", (F.col("stretch") + 1) * span - 2)
    text = F.array_join(F.concat(F.array(*(c.cast("string") for c in own)), "words"), " ")
    units = kept.keep(blocks.groupBy("src_id", "stretch").agg(F.array_join(F.collect_list(text), "\n").alias("unit"), F.count("*").alias("n")))
    groups = max(1, -(-(units.agg(F.sum("n")).first()[0] or 0) // GROUP))
    by = F.pmod(F.xxhash64("src_id", "stretch"), F.lit(groups))
    grouped = units.groupBy(by.alias("group")).agg(F.collect_list(F.struct("src_id", "unit")).alias("of"))
    grouped = kept.checked(grouped.select(F.col("of.src_id").alias("sources"), F.array_join("of.unit", "\n\n").alias("text")))

    # Null without lines; a filter in their place would cut every text twice.
    docs = tgt.select("doc_id", let(F.col("lines"), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n"))).alias("text"))
    bunches = max(1, -(-tgt.count() // BUNCH))
    bunched = docs.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(bunches)).alias("bunch")).agg(F.collect_list(F.struct("doc_id", "text")).alias("docs"))
    out = StructType([src.schema["src_id"], tgt.schema["doc_id"], StructField("line_no", IntegerType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=8)(Group)
        for batch in batches:
            for sources, text, docs in zip(*(batch[c] for c in ("sources", "text", "docs"))):
                ids, texts, rows = docs.values.field("doc_id"), docs.values.field("text").to_pylist(), {}
                for k, d in enumerate(ids.to_pylist()):
                    if texts[k] is not None:
                        rows.setdefault(d, []).append(k)
                if not rows:
                    continue
                group = known(text.as_py())
                doc, at = group.marked([cut([texts[k] for k in ks], r) for ks in rows.values()])
                first = np.array([ks[0] for ks in rows.values()])
                columns = sources.values.take(pa.array(group.source[at])), ids.take(pa.array(first[doc])), pa.array(group.line[at], pa.int32())
                yield pa.RecordBatch.from_arrays(list(columns), ["src_id", "doc_id", "line_no"])

    return bunched.crossJoin(grouped).select("sources", "text", "docs").mapInArrow(marked, out)
