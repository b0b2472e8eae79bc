"""Line matching: pruned similarity join, first-fit assignment, document ranking.

Plainly, every source line is compared with every target line. Here a pair is scored only if it
can qualify. At threshold t a source line of n pieces must share at least ceil(t * n)
of them (as a multiset) with its partner, so the partner holds one of any n - ceil(t * n) + 1
numbered pieces of the source line; the rarest ones are taken. That turns the theta join into an
equi-join on pieces. Only ids, lengths and single pieces go through it, so a line of any length
costs as much as it has pieces; whole lines are fetched for the pairs that are left, then scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import similarity as S
from ..functions import tokens as T
from .lines import TABLE_LINE, explode, rows, segment_full, segment_plain, sentences, with_index

#: Source rows are broadcast up to so many, and up to so many bytes; beyond, the joins are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 256 << 20
#: Words of the source lines are numbered up to so many, and up to so many bytes: the list goes to every task.
NUMBERED_WORDS, NUMBERED_BYTES = 200_000, 16 << 20
#: The number of a word that no source line has, and of a blank.
FOREIGN, GAP = -1, -2
#: Bytes of an Arrow batch of line pairs.
BATCH_BYTES = 32 << 20
#: Source ids of one block in ``rank``.
BLOCK = 1_000
_EPS = 1e-9


@dataclass(frozen=True)
class SearchParams:
    """rate: least similarity of a matched pair. min_words: index words that a source line needs.
    is_jp: compare index forms instead of lines. rough_lines: block size of the lossy prefilter, 0 off.
    separators: blanks between pieces count as pieces. accept_zero: at rate 0, pairs that share nothing qualify;
    such a pair takes its lines, but is no match. exclude_tables: numeric lines take no part and do not count.
    segmenter: "plain" or "full" cuts the texts into lines first, none takes sentences as they stand."""

    rate: float = 0.6
    min_words: int = 10
    is_jp: bool = False
    rough_lines: int = 0
    separators: bool = False
    accept_zero: bool = False
    exclude_tables: bool = False
    segmenter: str | None = None


@dataclass
class Kept:
    """Rows of one search that were measured and are kept until its result has been written."""

    frames: list[DataFrame] = field(default_factory=list)

    def keep(self, df: DataFrame) -> DataFrame:
        df = df.persist()
        self.frames.append(df)
        return df

    def measured(self, df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
        """``df``, kept, and whether it has no more than so many rows and bytes."""
        df = self.keep(df)
        few = df.count() <= rows
        return df, few and int(str(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size

    def checked(self, df: DataFrame) -> DataFrame:
        """Broadcast after its rows and bytes are measured; a large side is left to a shuffled join. The
        measured rows are kept, as the join would make them again."""
        df, few = self.measured(df)
        return F.broadcast(df) if few else df

    def release(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()


@dataclass
class Found:
    """Result of one search: ``matches`` and ``ranked``, also as a pair. Leaving its ``with`` block, or
    ``release``, frees the rows that this search keeps, and no other's."""

    matches: DataFrame
    ranked: DataFrame
    kept: Kept

    def __iter__(self):
        return iter((self.matches, self.ranked))

    def __getitem__(self, i: int) -> DataFrame:
        return (self.matches, self.ranked)[i]

    def __enter__(self) -> Found:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        self.kept.release()


def words(is_jp: bool = False) -> Column:
    """The pieces that are compared, of a line's text or of its index form."""
    return T.pieces(T.split_words(F.col("text")) if is_jp else F.col("text"))


def line_table(docs: DataFrame, id_col: str, is_jp: bool = False, segmented: bool = False) -> DataFrame:
    """``(id, line_no, text, idx, n_idx_words, words)`` of all lines with content. The index form is made only
    where something reads it. A ``segmented`` text has its lines at line feeds."""
    lines = explode(docs, id_col, (rows if segmented else sentences)(F.col("text")))
    lines = with_index(lines.filter((F.col("text") != "") & T.any_token(F.col("text"))))
    return lines.withColumn("words", words(is_jp))


def in_table(lines: DataFrame) -> Column:
    """Numeric lines are left out as tables, but for the line that a text begins with."""
    return _numeric(F.col("line_no"), F.col("text"))


def _numeric(line_no: Column, text: Column) -> Column:
    return (line_no > 0) & F.trim(text).rlike(TABLE_LINE)


def eligible(lines: DataFrame, params: SearchParams) -> DataFrame:
    """Source lines that take part: long enough, and no table line if those are excluded."""
    lines = lines.filter(F.col("n_idx_words") >= (F.col("min_words") if "min_words" in lines.columns else params.min_words))
    return lines.filter(~in_table(lines)) if params.exclude_tables else lines


def _rate(src: DataFrame, params: SearchParams) -> Column:
    return F.col("rate") if "rate" in src.columns else F.lit(float(params.rate))


def prefixes(src: DataFrame, seen: DataFrame, params: SearchParams, shared: int = 1) -> DataFrame:
    """``(src_id, src_line, n, t, w, k)``: of each source line the rarest numbered pieces of which a partner
    must hold one. ``seen(w, df)`` counts the target lines of a piece. A piece's repetitions are numbered by
    its count, so the work is linear in the line.

    With more ``shared``, so many pieces more are named and a partner must hold ``shared`` of them, or all that it
    must hold at all if those are fewer; the place ``at``, that number and the ``bound`` are given as well."""
    t = _rate(src, params)
    # With separators counted a match also earns blanks; a weaker bound on shared pieces stays lossless.
    bound = F.greatest(F.lit(0.0), 2 * t - 1 if params.separators else t)
    scope = [c for c in ("scope",) if c in src.columns]
    each = src.select("src_id", F.col("line_no").alias("src_line"), *scope, t.alias("t"), bound.alias("bound"), F.size("words").alias("n"), F.explode("words").alias("w"))
    counts = each.groupBy("src_id", "src_line", *scope, "t", "bound", "n", "w").agg(F.count("*").alias("c"))
    pieces = counts.join(seen, "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    pieces = pieces.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)))
    at = F.row_number().over(W.partitionBy("src_id", "src_line").orderBy("df", "w", "k"))
    need = F.ceil(F.col("bound") * F.col("n") - _EPS)
    shares = F.least(F.lit(shared), F.greatest(need, F.lit(1)))
    named = pieces.withColumn("at", at).withColumn("shared", shares).filter((F.col("at") <= F.col("n") - need + F.col("shared")) & (F.col("df") > 0))
    return named.select("src_id", "src_line", *scope, "n", "t", "w", "k", *(["at", "shared", "bound"] if shared > 1 else []))


def postings(tgt: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(w, doc_id, tgt_line, m, c)``: where a piece stands, in a line of how many pieces, how often; of the
    pieces in ``vocabulary(w)`` only, if given. No row carries a line."""
    scope = [c for c in ("scope",) if c in tgt.columns]
    each = tgt.select("doc_id", F.col("line_no").alias("tgt_line"), *scope, F.size("words").alias("m"), F.explode("words").alias("w"))
    if vocabulary is not None:
        each = each.join(vocabulary, "w", "left_semi")
    return each.groupBy("w", "doc_id", "tgt_line", *scope, "m").agg(F.count("*").alias("c"))


def frequencies(tgt: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(w, df)``: target lines that hold a piece of ``vocabulary(w)``."""
    return tgt.select(F.explode(F.array_distinct("words")).alias("w")).join(vocabulary, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))


def _fits(n: Column, m: Column, t: Column, params: SearchParams) -> Column:
    """Two lines of n and m pieces can reach t at all."""
    if params.separators:
        n, m = 2 * n - 1, 2 * m - 1
    return F.least(n, m) >= t * F.greatest(n, m) - _EPS


def candidate_ids(keys: DataFrame, where: DataFrame, params: SearchParams) -> DataFrame:
    """``(src_id, src_line, doc_id, tgt_line)``: pairs that may reach the rate, each once, from ``prefixes`` and
    ``postings``. A longer partner must hold more, so fewer of the places count for it."""
    met = where.join(keys, [c for c in ("w", "scope") if c in keys.columns])
    met = met.filter(_fits(F.col("n"), F.col("m"), F.col("t"), params) & (F.col("c") > F.col("k")))
    pair = ["src_id", "src_line", "doc_id", "tgt_line"]
    if "shared" not in keys.columns:
        return met.select(*pair).distinct()
    need = F.ceil(F.col("bound") * F.greatest("n", "m") - _EPS)
    met = met.filter(F.col("at") <= F.col("n") - need + F.col("shared"))
    return met.groupBy(*pair, "shared").agg(F.count("*").alias("held")).filter("held >= shared").select(*pair)


def candidates(src: DataFrame, tgt: DataFrame, params: SearchParams, allowed: DataFrame | None = None, kept: Kept | None = None) -> DataFrame:
    """Pairs ``(src_id, src_line, doc_id, tgt_line, src_words, tgt_words)`` that may reach the rate; all that do
    are among them, each once. ``allowed`` names the pairs of documents (and source lines) that count."""
    kept = kept or Kept()
    t = params.rate
    if params.exclude_tables:
        src, tgt = (x.filter(~in_table(x)) for x in (src, tgt))
    if t <= 0 and params.accept_zero:  # by definition the stated source lines meet every target line
        left = src.select("src_id", F.col("line_no").alias("src_line"), F.col("words").alias("src_words"))
        return _only(tgt.select("doc_id", F.col("line_no").alias("tgt_line"), F.col("words").alias("tgt_words")).crossJoin(kept.checked(left)), allowed)
    src = src.filter(F.size("words") > 0)
    if params.separators and t <= 0.5:
        return _only(_banded(src, tgt, params, kept), allowed)
    vocabulary, few = kept.measured(src.select(F.explode("words").alias("w")).distinct(), NUMBERED_WORDS, NUMBERED_BYTES)
    if few and "text" in src.columns and "text" in tgt.columns:
        src, tgt, bound = numbered(src, tgt, [r[0] for r in vocabulary.collect()], params, kept)
        return attached(_only(numbered_ids(src, tgt, bound, params, kept), allowed), src, tgt, params, kept)
    keys = kept.checked(prefixes(src, frequencies(tgt, vocabulary), params))
    ids = candidate_ids(keys, postings(tgt, kept.checked(keys.select("w").distinct())), params)
    return attached(_only(ids, allowed), src, tgt, params, kept)


def _numbers(known: list[str], bound: float = 0.0):
    """The pieces of a line as their places in ``known``, others as ``FOREIGN``; null for a line without a known one
    or with less than the share ``bound`` of them."""
    known = pa.array(known, pa.string())

    @F.arrow_udf("array<int>")
    def numbers(lines: pa.Array) -> pa.Array:
        cut = pc.split_pattern(lines, " ")
        words = cut.flatten()
        row = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
        some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        at, row = pc.fill_null(pc.index_in(words, value_set=known), FOREIGN).to_numpy()[some], row[some]
        size, hits = np.bincount(row, minlength=len(cut)), np.bincount(row[at >= 0], minlength=len(cut))
        few = hits < np.maximum(1, np.ceil(bound * size - _EPS))
        size[few] = 0
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(at[~few[row]]), mask=pa.array(few))

    return numbers


def _rarest(ranks: np.ndarray, bound: float):
    """Of a line of numbered words the rarest pieces of which a partner must hold one, as ``word << 32 | repetition``.
    Foreign words are the rarest of all: they fill places, but no source line holds them."""

    @F.arrow_udf("array<bigint>")
    def rarest(words: pa.Array) -> pa.Array:
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        size, flat = np.diff(ends), words.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        rank = np.where(flat < 0, FOREIGN, ranks[flat])
        order = np.lexsort((rank, row))
        w, at = flat[order].astype("int64"), np.arange(len(flat))
        begins = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(rank[order], prepend=-1))
        again = at - np.repeat(begins, np.diff(begins, append=len(flat)))
        places = size - np.ceil(bound * size - _EPS).astype("int64") + 1
        taken = (w >= 0) & (at - np.repeat(ends[:-1], size) < np.repeat(places, size))
        counts = np.bincount(row[taken], minlength=len(size))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array((w << 32 | again)[taken]))

    return rarest


def numbered(src: DataFrame, tgt: DataFrame, known: list[str], params: SearchParams, kept: Kept) -> tuple[DataFrame, DataFrame, float]:
    """Both sides with numbers in the place of ``known`` words, all that source lines have, and the least share of
    pieces that a pair must have in common. A target line with fewer known words is left out; the others are kept,
    so the documents are read and cut once and what follows compares numbers."""
    tgt.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    line = T.split_words(F.col("text")) if params.is_jp else F.col("text")
    src = kept.keep(src.withColumn("words", _numbers(known)(line)))
    least = src.agg(F.min(_rate(src, params))).first()[0]
    least = float(params.rate) if least is None else least
    bound = max(0.0, 2 * least - 1 if params.separators else least)
    scope = [c for c in ("scope",) if c in tgt.columns]
    tgt = kept.keep(tgt.select("doc_id", "line_no", *scope, _numbers(known, bound)(line).alias("words")).filter("words is not null"))
    return src, tgt, bound


def numbered_ids(src: DataFrame, tgt: DataFrame, bound: float, params: SearchParams, kept: Kept) -> DataFrame:
    """``candidate_ids`` of numbered lines. Both lines of a pair put their pieces into one order, the rarest first, so
    the partner's piece is also among the first of its own line, and only those are looked at."""
    seen = tgt.select(F.explode(F.array_distinct("words")).alias("w")).filter("w >= 0").groupBy("w").agg(F.count("*").alias("df"))
    seen = kept.checked(seen)
    order = [r[0] for r in seen.select("w", "df").orderBy("df", "w").collect()]
    ranks = np.zeros(max(order, default=0) + 1, "int64")
    ranks[order] = np.arange(len(order))
    keys = prefixes(src, seen, params).withColumn("piece", F.shiftleft(F.col("w").cast("bigint"), 32).bitwiseOR(F.col("k"))).drop("w", "k")
    keys = kept.checked(keys)
    scope = [c for c in ("scope",) if c in keys.columns]
    where = tgt.select("doc_id", F.col("line_no").alias("tgt_line"), *scope, F.size("words").alias("m"), _rarest(ranks, bound)("words").alias("pieces"))
    met = where.withColumn("piece", F.explode("pieces")).join(keys, ["piece", *scope]).filter(_fits(F.col("n"), F.col("m"), F.col("t"), params))
    return met.select("src_id", "src_line", "doc_id", "tgt_line").distinct()


def attached(ids: DataFrame, src: DataFrame, tgt: DataFrame, params: SearchParams, kept: Kept) -> DataFrame:
    """Pairs with their pieces. The pairs are sent to the lines while they are few, so the target side stays
    where it is; lines are cut into pieces only where a pair names them."""
    ids = kept.checked(ids)
    left = kept.checked(src.select("src_id", F.col("line_no").alias("src_line"), F.col("words").alias("src_words"), *(["rate"] if "rate" in src.columns else [])))
    stored = "words" if "text" not in tgt.columns else "text"
    both = tgt.select("doc_id", F.col("line_no").alias("tgt_line"), stored).join(ids, ["doc_id", "tgt_line"])
    both = both.withColumn("tgt_words", words(params.is_jp) if stored == "text" else F.col("words")).drop(stored)
    return both.join(left, ["src_id", "src_line"]).select("src_id", "src_line", "doc_id", "tgt_line", "src_words", "tgt_words", *(["rate"] if "rate" in src.columns else []))


def _banded(src: DataFrame, tgt: DataFrame, params: SearchParams, kept: Kept) -> DataFrame:
    """Where blanks alone can reach the rate no piece need be shared, so only lengths prune: lengths are put
    into bands of a factor 1 / rate, and partners stand in the same band or a neighbouring one."""
    step = math.log(1 / params.rate) if params.rate > 0 else None

    def band(size: Column) -> Column:
        return F.floor(F.log(2.0 * size - 1) / step).cast("int") if step else F.lit(0)

    left = src.select("src_id", F.col("line_no").alias("src_line"), F.col("words").alias("src_words"), F.explode(F.sequence(band(F.size("words")) - 1, band(F.size("words")) + 1)).alias("band"))
    right = tgt.filter(F.size("words") > 0).select("doc_id", F.col("line_no").alias("tgt_line"), F.col("words").alias("tgt_words"), band(F.size("words")).alias("band"))
    both = right.join(kept.checked(left), "band")
    return both.filter(_fits(F.size("src_words"), F.size("tgt_words"), F.lit(params.rate), params)).drop("band")


def _only(pairs: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if allowed is None:
        return pairs
    return pairs.join(allowed, [c for c in ("src_id", "doc_id", "src_line") if c in allowed.columns], "left_semi")


def similarity_join(src: DataFrame, tgt: DataFrame, params: SearchParams, native: bool = False, allowed: DataFrame | None = None, kept: Kept | None = None) -> DataFrame:
    """``(src_id, src_line, doc_id, tgt_line, match_words, total_words, rate)`` of all pairs at the rate or above.

    At rate 0 every pair with a common piece qualifies, with ``accept_zero`` every pair."""
    return scored(candidates(src, tgt, params, allowed, kept), params, native)


def scored(pairs: DataFrame, params: SearchParams, native: bool = False) -> DataFrame:
    """Candidate pairs with their exact similarity, those below the rate left out."""
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    least = _rate(pairs, params)
    a, b = F.col("src_words"), F.col("tgt_words")
    numbers = isinstance(pairs.schema["src_words"].dataType.elementType, IntegerType)
    x, y = (S.with_blanks(c, GAP if numbers else " ") if params.separators else c for c in (a, b))
    done = pairs.withColumn("least", least).withColumn("lcs", S.lcs_native(x, y) if native else S.lcs_arrow(x, y))
    match, total, rate = S.word_rate(a, b, F.col("lcs"), params.separators)
    done = done.select("src_id", "src_line", "doc_id", "tgt_line", match.cast("int").alias("match_words"), total.cast("int").alias("total_words"), rate.alias("rate"), "least")
    return done.filter((F.col("rate") >= F.col("least")) & ((F.col("rate") > 0) | F.lit(params.accept_zero))).drop("least")


def greedy(pairs: DataFrame) -> DataFrame:
    """First fit: source lines in order, each with the lowest free target line. The same as walking all
    pairs by (source, target) and taking a pair when both its ends are free.

    One shuffle by pair of documents and one external sort; a task then streams its rows and holds only the
    taken lines of the pair of documents it is at, so a pair with any number of matches fits."""
    key = ["src_id", "doc_id"]
    rows = pairs.select(*key, "src_line", "tgt_line", "match_words", "total_words", "rate")
    walked = rows.repartition(*key).sortWithinPartitions(*key, "src_line", "tgt_line")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, taken = None, None, set()
        for b in batches:
            keep = []
            for src, doc, line, other in zip(*(b.column(c).to_pylist() for c in ("src_id", "doc_id", "src_line", "tgt_line"))):
                if (src, doc) != at:
                    at, last, taken = (src, doc), None, set()
                free = line != last and other not in taken
                if free:
                    last = line
                    taken.add(other)
                keep.append(free)
            yield b.filter(pa.array(keep, pa.bool_()))

    return walked.mapInArrow(walk, walked.schema)


def totals(src_lines: DataFrame, params: SearchParams) -> DataFrame:
    """Lines of each source that took part: the denominator of document rates."""
    return eligible(src_lines, params).groupBy("src_id").agg(F.count("*").cast("int").alias("total"))


def rank(matches: DataFrame, sources: DataFrame, total: DataFrame, targets: DataFrame) -> DataFrame:
    """``(src_id, doc_id, match_count, total, rate)`` for each of the stated ``sources(src_id)`` and every target.

    Pairs without a match, and targets without text, get a zero row. The sources are a query set: they go
    to the targets in blocks of ids, and the counts are sent there while they are few, so no row is moved."""
    kept = Kept()
    counted, total = kept.checked(_counted(matches)), kept.checked(total)
    ids = sources.select("src_id").distinct()
    blocks = -(-ids.count() // BLOCK)
    listed = ids.groupBy(F.pmod(F.xxhash64("src_id"), F.lit(max(1, blocks))).alias("block")).agg(F.collect_list("src_id").alias("ids"))
    every = targets.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, blocks) - 1).cast("bigint"))).alias("block")).join(kept.checked(listed), "block")
    every = every.select("doc_id", F.explode("ids").alias("src_id"))
    out = every.join(counted, ["src_id", "doc_id"], "left").join(total, "src_id", "left")
    out = out.select("src_id", "doc_id", F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("total", F.lit(0)).alias("total"))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("match_count").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def _counted(matches: DataFrame) -> DataFrame:
    """A pair that shares nothing has taken its lines, but is no match."""
    return _pair_counts(matches.filter("rate > 0"))


def _pair_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("src_id", "doc_id").agg(F.count("*").cast("int").alias("match_count"))


def matched_rank(matches: DataFrame, total: DataFrame) -> DataFrame:
    """Like ``rank`` without the zero rows: what a large corpus wants."""
    return _rated(_counted(matches), total)


def _rated(counted: DataFrame, total: DataFrame) -> DataFrame:
    return counted.join(total, "src_id").withColumn("rate", F.col("match_count") / F.col("total").cast("double"))


def first_lines(docs: DataFrame, id_col: str, most: int, params: SearchParams) -> DataFrame:
    """``(id, k, line_no, words)`` of the first ``most`` lines that ``line_table`` gives of each text, without the
    tables if those are excluded. They are picked inside the row, so no line is moved and no other is cut."""
    cut = (rows if params.segmenter else sentences)(F.col("text"))
    lines = F.transform(cut, lambda x, i: F.struct(i.alias("line_no"), x.alias("text")))

    def counts(x: Column) -> Column:
        some = (x["text"] != "") & T.any_token(x["text"])
        return some & ~_numeric(x["line_no"], x["text"]) if params.exclude_tables else some

    picked = docs.select(id_col, F.posexplode(F.slice(F.filter(lines, counts), 1, most)).alias("k", "at"))
    return picked.select(id_col, (F.col("k") + 1).alias("k"), "at.line_no", "at.text").withColumn("words", words(params.is_jp)).drop("text")


def first_fit_of_all(src: DataFrame, targets: DataFrame, params: SearchParams, allowed: DataFrame | None, kept: Kept) -> DataFrame:
    """First fit where every pair qualifies (rate 0, ``accept_zero``): the k-th source line gets the k-th target
    line, so nothing is crossed. Pairs that share nothing are left out; the others are not scored yet."""
    if params.exclude_tables:
        src = src.filter(~in_table(src))
    left = src.select("src_id", F.col("line_no").alias("src_line"), F.col("words").alias("src_words"), F.row_number().over(W.partitionBy("src_id").orderBy("line_no")).alias("k"))
    left = kept.checked(left)
    most = left.agg(F.max("k")).first()[0] or 0
    right = first_lines(targets, "doc_id", most, params).withColumnsRenamed({"line_no": "tgt_line", "words": "tgt_words"})
    return _only(right.join(left, "k").filter(F.arrays_overlap("src_words", "tgt_words")).drop("k"), allowed)


def search(sources: DataFrame, targets: DataFrame, params: SearchParams = SearchParams(), requests: DataFrame | None = None) -> Found:
    """``sources(src_id, text)`` against ``targets(doc_id, text)`` -> (matched lines, ranked documents).

    ``requests(src_id, doc_id)``, if given, is the queue of pairs to look at; a repeated request counts once."""
    kept = Kept()
    if params.segmenter:
        sources, targets = segmented(sources, "src_id", params), segmented(targets, "doc_id", params)
    src, tgt = line_table(sources, "src_id", params.is_jp, bool(params.segmenter)), line_table(targets, "doc_id", params.is_jp, bool(params.segmenter))
    if params.exclude_tables:
        src = src.filter(~in_table(src))
    if requests is not None:
        requests = requests.select("src_id", "doc_id").distinct()
        targets, tgt = (x.join(requests, "doc_id", "left_semi") for x in (targets, tgt))
    if params.rate <= 0 and params.accept_zero and not params.rough_lines:
        met = first_fit_of_all(eligible(src, params), targets, params, requests, kept)
        return Found(scored(met, params).filter("rate > 0"), _rated(_pair_counts(met), totals(src, params)), kept)

    def matched(allowed: DataFrame | None) -> DataFrame:
        return greedy(similarity_join(eligible(src, params), tgt, params, allowed=allowed, kept=kept)).filter("rate > 0")

    if not params.rough_lines:
        matches = matched(requests)
        return Found(matches, matched_rank(matches, totals(src, params)), kept)
    from .rough import rough_lines

    every = bool(params.segmenter)
    named, pairs = requests, None
    if not (params.rate <= 0 and params.accept_zero):
        # Pairs at the rate are few, so only their documents are looked at roughly; the outcome is the same.
        pairs = kept.checked(similarity_join(eligible(src, params), tgt, params, allowed=requests, kept=kept))
        named = kept.checked(pairs.select("src_id", "doc_id").distinct())
    own = {c: d if named is None else d.join(named.select(c).distinct(), c, "left_semi") for c, d in (("src_id", sources), ("doc_id", targets))}
    whole = own["doc_id"].select("doc_id", (rows if every else sentences)(F.col("text")).alias("lines"))
    marked = rough_lines(numbered_lines(own["src_id"], "src_id", every), whole, params.rough_lines)
    marked = marked if named is None else kept.checked(marked.join(named, ["src_id", "doc_id"], "left_semi"))
    allowed = marked.withColumnRenamed("line_no", "src_line")
    matches = matched(allowed) if pairs is None else greedy(_only(pairs, allowed)).filter("rate > 0")
    # Lines that the rough filter turns away count in the total whatever their length.
    short = src.filter(F.col("n_idx_words") < params.min_words).join(marked, ["src_id", "line_no"]).groupBy("src_id", "doc_id").agg(F.count("*").alias("short"))
    lines = src.groupBy("src_id").agg(F.count("*").alias("lines"))
    counted = _counted(matches).join(lines, "src_id")
    total = (F.col("lines") - F.coalesce("short", F.lit(0))).cast("int")
    ranked = counted.join(short, ["src_id", "doc_id"], "left").select("src_id", "doc_id", "match_count", total.alias("total"))
    return Found(matches, ranked.withColumn("rate", F.try_divide(F.col("match_count").cast("double"), F.col("total").cast("double"))), kept)


def search_queue(sources: DataFrame, targets: DataFrame, queue: DataFrame, params: SearchParams = SearchParams()) -> Found:
    """A queue of searches in one pass: ``queue(request_id, src_id, scope, is_jp, rate, min_words)``, any of the
    last three null for that of ``params``, against ``targets(doc_id, text, scope)`` of the request's scope.

    Results are those of a search for each request, with ``request_id`` in the place of the source: the
    settings are columns that the prefix filter reads, and the scope is a part of its join key."""
    kept = Kept()
    default = {"is_jp": params.is_jp, "rate": float(params.rate), "min_words": params.min_words}
    asked = queue.select("request_id", "src_id", "scope", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in default.items()))
    parts = []
    for is_jp in (False, True):
        mine = asked.filter(F.col("is_jp") == is_jp).drop("is_jp")
        its = sources.select("src_id", "text").join(mine, "src_id").select(F.struct("request_id", "scope", "rate", "min_words").alias("key"), "text")
        src = line_table(its, "key", is_jp).select(F.col("key.request_id").alias("src_id"), "key.scope", "key.rate", "key.min_words", "line_no", "text", "n_idx_words", "words")
        scopes = kept.checked(mine.select("scope").distinct())
        named = targets.join(scopes, "scope", "left_semi").select(F.struct("doc_id", "scope").alias("key"), "text")
        tgt = line_table(named, "key", is_jp).select("key.doc_id", "key.scope", "line_no", "text", "words")
        own = SearchParams(rate=params.rate, is_jp=is_jp, exclude_tables=params.exclude_tables)
        pairs = greedy(similarity_join(eligible(src, own), tgt, own, kept=kept))
        parts.append((pairs, totals(src, own)))
    matches, total = (a.unionByName(b) for a, b in zip(*parts))
    name = lambda df: df.withColumnRenamed("src_id", "request_id")
    return Found(name(matches), name(matched_rank(matches, total)), kept)


def segmented(docs: DataFrame, id_col: str, params: SearchParams) -> DataFrame:
    """``(id, text)`` cut into lines by the chosen segmenter."""
    if params.segmenter == "full":
        return segment_full(docs, id_col, exclude_tables=params.exclude_tables)
    if params.segmenter != "plain":
        raise ValueError(f"no segmenter {params.segmenter!r}")
    return docs.select(id_col, segment_plain(F.coalesce("text", F.lit(""))).alias("text"))


def numbered_lines(docs: DataFrame, id_col: str, segmented: bool = False) -> DataFrame:
    """All lines, empty ones too, with their index form."""
    return with_index(explode(docs, id_col, (rows if segmented else sentences)(F.col("text"))))
