"""A stored index of a corpus, made once and read by every later search.

Two tables under one path: ``lines`` and ``postings`` (piece -> lines, with counts). The postings are bucketed by
piece, so a search shuffles its own side only. They are stored as lists, one text for many lines: tasks make them
before anything is shuffled, and a search unrolls only those of the pieces it looks for. Documents are added in
batches: a batch's rows count once the batch is named in ``batches``, which is written last, so an addition that
failed half-way is not seen and can be repeated.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import matching as M

BUCKETS = 64
#: Lines of one list at most, as a reader holds some thousands of lists; text that a task lists at once, and lines
#: that it hands over at once.
LIST_LINES, LISTED_BYTES, HANDED_LINES = 1024, 6 << 20, 1 << 16
#: Pieces that a line must share with a source line before its text is read: more of them read more lists.
SHARED = 2
#: Known documents up to so many are sent to the new ones; beyond, texts are shuffled.
KNOWN_ROWS = 4_000_000
#: Columns of the bucketed tables: ``n`` lines hold the piece ``c`` times each.
_TABLES = {"postings": "w STRING, c BIGINT, n INT, list STRING, batch STRING"}
#: Columns whose values hardly repeat get no dictionary.
_PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("w", "list", "text")}
#: Between the parts of an entry, and between the entries of a list; kinds of ids that hold neither.
_PART, _ENTRY, _WHOLE = ":", " ", ("bigint", "int", "smallint", "tinyint")


def _written(doc_id: Column, kind: str) -> Column:
    """An id in a list: in digits where it may hold the signs between parts."""
    return doc_id.cast("string") if kind in _WHOLE else F.hex(doc_id.cast("string"))


def _unrolled(found: DataFrame, kind: str) -> DataFrame:
    """``(w, doc_id, tgt_line, m, c)``: a row for each line of lists."""
    parts = found.select("w", "c", F.explode(F.split("list", _ENTRY)).alias("e")).select("w", "c", F.split("e", _PART).alias("e"))
    doc = F.get("e", F.lit(2))
    doc = doc.cast(kind) if kind in _WHOLE else F.unhex(doc).cast("string").cast(kind)
    return parts.select("w", doc.alias("doc_id"), F.get("e", F.lit(0)).cast("int").alias("tgt_line"), F.get("e", F.lit(1)).cast("int").alias("m"), "c")


def _listed(line: pa.Array, doc: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """Lists of the pieces of these lines, in batches: ``(w, c, n, list)``."""
    cut = pc.split_pattern(text, " ")
    words = cut.flatten()
    row = np.repeat(np.arange(len(cut), dtype="int32"), np.diff(cut.offsets.to_numpy()))
    some = pc.not_equal(words, "")
    row, words = row[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    entry = pc.binary_join_element_wise(line.cast(pa.string()), pa.array(np.bincount(row, minlength=len(cut))).cast(pa.string()), doc, _PART)
    # A number for each word of a line, in order; equal ones are the word's repetitions in it.
    held = words.indices.to_numpy().astype("int64") * len(cut) + row
    held.sort()
    at = np.flatnonzero(np.diff(held, prepend=-1))
    c = np.diff(at, append=len(held))
    w, row = np.divmod(held[at], max(1, len(cut)))
    order = np.argsort(w * (c.max(initial=0) + 1) + c, kind="stable")
    w, row, c = w[order], row[order], c[order]
    first = np.flatnonzero(np.diff(w, prepend=-1) | np.diff(c, prepend=-1))
    size = np.diff(first, append=len(w))
    begins = np.flatnonzero((np.arange(len(w)) - np.repeat(first, size)) % LIST_LINES == 0)
    ends, at = np.append(begins, len(w)), 0
    while at < len(begins):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + HANDED_LINES, "right")) - 1)
        some = ends[at : upto + 1]
        lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype("int32")), entry.take(pa.array(row[some[0] : some[-1]])))
        columns = (words.dictionary.take(pa.array(w[some[:-1]])), pa.array(c[some[:-1]].astype("int64")), pa.array(np.diff(some).astype("int32")), pc.binary_join(lists, _ENTRY))
        yield pa.RecordBatch.from_arrays([*columns], ["w", "c", "n", "list"])
        at = upto


def listed(lines: DataFrame) -> DataFrame:
    """``(w, c, n, list)`` of ``lines(doc_id, line_no, text)``: the n lines that hold the piece w c times each, with
    the number of their pieces. A task makes the lists of some of its lines at a time."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= LISTED_BYTES:
                yield from _listed(*(pa.concat_arrays(x.column(i) for x in held) for i in range(3)))
                held, size = [], 0
        if held:
            yield from _listed(*(pa.concat_arrays(x.column(i) for x in held) for i in range(3)))

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.select("line_no", _written(F.col("doc_id"), kind).alias("id"), "text").mapInArrow(made, "w string, c bigint, n int, list string")


class LineIndex:
    """The index at ``path``; ``create`` makes an empty one. It holds lines as ``settings`` cuts and compares them:
    ``segmenter`` and ``is_jp`` of the search parameters."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        kept = spark.read.parquet(f"{self.path}/settings").first()
        self.buckets, self.kind = kept["buckets"], kept["kind"]
        self.settings = M.SearchParams(is_jp=kept["is_jp"], segmenter=kept["segmenter"])
        name = hashlib.sha256(self.path.encode()).hexdigest()[:16]
        self.names = {t: f"line_index_{t}_{name}" for t in _TABLES}
        for t, columns in _TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({columns.format(self.kind)}) USING parquet CLUSTERED BY (w) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{t}'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, params: M.SearchParams = M.SearchParams(), kind: str = "bigint", buckets: int = BUCKETS) -> LineIndex:
        row = [(buckets, kind, params.is_jp, params.segmenter)]
        spark.createDataFrame(row, "buckets int, kind string, is_jp boolean, segmenter string").write.parquet(f"{path.rstrip('/')}/settings")
        spark.createDataFrame([], "batch string").write.parquet(f"{path.rstrip('/')}/batches")
        spark.createDataFrame([], f"doc_id {kind}, batch string").write.parquet(f"{path.rstrip('/')}/documents")
        lines = f"doc_id {kind}, line_no int, text string, batch string"
        spark.createDataFrame([], lines).write.parquet(f"{path.rstrip('/')}/lines")
        return cls(spark, path)

    def _batches(self) -> list[str]:
        return [r[0] for r in self.spark.read.parquet(f"{self.path}/batches").collect()]

    def table(self, name: str) -> DataFrame:
        """Rows of finished batches; of ``postings`` one for each piece of a line."""
        df = self._stored(name)
        return _unrolled(df, self.kind) if name == "postings" else df

    def _stored(self, name: str) -> DataFrame:
        df = self.spark.table(self.names[name]) if name in self.names else self.spark.read.parquet(f"{self.path}/{name}")
        return df.filter(F.col("batch").isin(self._batches())).drop("batch")

    def append(self, docs: DataFrame) -> str | None:
        """Adds the documents of ``docs(doc_id, text)`` whose id is new; gives the batch's name, or none if all are
        there. A null text counts as a document without lines; a repeated id, with all its rows, once."""
        name = uuid.uuid4().hex
        batch = F.lit(name).alias("batch")
        new = docs.select(F.col("doc_id").cast(self.kind).alias("doc_id"), "text").filter("doc_id is not null")
        known = self.table("documents")
        if count := known.count():
            new = new.join(F.broadcast(known) if count <= KNOWN_ROWS and self.kind in _WHOLE else known, "doc_id", "left_anti")
        new.select("doc_id").distinct().withColumn("batch", batch).write.mode("append").parquet(f"{self.path}/documents")
        ids = self.spark.read.parquet(f"{self.path}/documents").filter(F.col("batch") == name)
        if not ids.limit(1).count():
            return None
        s = self.settings
        cut = M.segmented(new, "doc_id", s) if s.segmenter else new
        lines = M.line_table(cut, "doc_id", s.is_jp, bool(s.segmenter)).select("doc_id", "line_no", "text", batch)
        lines.write.options(**_PLAIN).mode("append").parquet(f"{self.path}/lines")
        lines = self.spark.read.parquet(f"{self.path}/lines").filter(F.col("batch") == name)
        compared = lines.withColumn("text", T.split_words(F.col("text"))) if s.is_jp else lines
        self._write("postings", listed(compared).withColumn("batch", batch))
        self.spark.createDataFrame([(name,)], "batch string").write.mode("append").parquet(f"{self.path}/batches")
        return name

    def _write(self, name: str, df: DataFrame) -> None:
        """Adds rows to a bucketed table; postings of single lines become lists of one. A task has the rows of one
        bucket, so they are not sorted for it."""
        if "tgt_line" in df.columns:
            entry = F.concat_ws(_PART, "tgt_line", "m", _written(F.col("doc_id"), self.kind))
            df = df.select("w", "c", F.lit(1).alias("n"), entry.alias("list"), "batch")
        dealt = df.select(*self.spark.table(self.names[name]).columns).repartition(self.buckets, "w")
        conf, key = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(key)
        conf.set(key, "1")
        try:
            out = dealt.write.bucketBy(self.buckets, "w").options(**_PLAIN).option("path", f"{self.path}/{name}")
            out.mode("append").saveAsTable(self.names[name])
        finally:
            conf.set(key, before)
        self.spark.catalog.refreshTable(self.names[name])

    def search(self, sources: DataFrame, params: M.SearchParams = M.SearchParams()) -> M.Found:
        """``sources(src_id, text)`` against all documents of the index; the same as ``matching.search`` on
        them, but no document is cut or counted again. Blanks as pieces at low rates, accepted zeros and the
        rough filter look at whole texts and are not served."""
        if (params.is_jp, params.segmenter) != (self.settings.is_jp, self.settings.segmenter):
            raise ValueError("the index holds other lines: is_jp and segmenter must be its own")
        if params.rough_lines or params.accept_zero and params.rate <= 0 or params.separators and params.rate <= 0.5:
            raise ValueError("not a search by shared pieces")
        kept = M.Kept()
        cut = M.segmented(sources, "src_id", params) if params.segmenter else sources
        src = M.line_table(cut, "src_id", params.is_jp, bool(params.segmenter))
        lines = self.table("lines")
        if params.exclude_tables:
            src, lines = (x.filter(~M.in_table(x)) for x in (src, lines))
        able = M.eligible(src, replace(params, exclude_tables=False))
        vocabulary = kept.checked(able.select(F.explode("words").alias("w")).distinct())
        stored = self._stored("postings").join(vocabulary, "w", "left_semi")
        seen = stored.groupBy("w").agg(F.sum("n").alias("df"))
        keys = kept.checked(M.prefixes(able, seen, params, SHARED))
        named = stored.join(kept.checked(keys.select("w").distinct()), "w", "left_semi")
        ids = M.candidate_ids(keys, _unrolled(named, self.kind), params)
        pairs = M.attached(ids, able, lines.select("doc_id", "line_no", "text"), params, kept)
        matches = M.greedy(M.scored(pairs, params))
        return M.Found(matches, M.matched_rank(matches, M.totals(src, replace(params, exclude_tables=False))), kept)
