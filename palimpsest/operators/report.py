"""Reports over matched lines: histogram, pivot, subtotals, details, colours, re-scoring, order.

Matches are few beside the lines of a corpus. Where both meet, the matches are counted and sent to the lines,
which stay where they are; only if they are too many are lines shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity as S
from .matching import Kept


def few(df: DataFrame) -> DataFrame:
    """Counted, and broadcast if small."""
    return Kept().checked(df)


def source_totals(lines: DataFrame, id_col: str) -> DataFrame:
    """Lines with content and their characters."""
    return lines.filter(F.col("text") != "").groupBy(id_col).agg(F.count("*").alias("line_count"), F.sum(F.length("text")).cast("bigint").alias("char_count"))


def level(rate: Column) -> Column:
    """Ten levels down from 1; computed in doubles, so 0.7 falls in level 4."""
    return F.least(F.lit(9), F.greatest(F.lit(0), F.ceil((1 - rate) * 10).cast("int")))


def histogram(matches: DataFrame) -> DataFrame:
    return matches.withColumn("level", level(F.col("rate"))).groupBy("src_id", "level").agg(F.sum("match_words").alias("words"))


def pivot(matches: DataFrame, ranked: DataFrame) -> DataFrame:
    """Matched words by level 0 to 5 and over all levels, of documents whose shown rate is above 0."""
    matches = matches.persist()  # the ranking is made from them too
    shown = ranked.filter(F.round(F.col("rate") * 100, 2) > 0).select("src_id", "doc_id")
    lv = level(F.col("rate"))
    sums = [F.sum(F.when(lv == i, F.col("match_words")).otherwise(0)).alias(f"l{i}") for i in range(6)]
    return matches.groupBy("src_id", "doc_id").agg(*sums, F.sum("match_words").alias("total_words")).join(shown, ["src_id", "doc_id"], "left_semi")


def colour(rate: Column, document: bool = False) -> Column:
    """Colour class of a line; documents use another one for the middle class."""
    return F.when(rate == 1, "LightPink").when(rate >= 0.9, "Cyan" if document else "Yellow").when(rate > 0, "LightGreen").otherwise("White")


#: Bands of the subtotals, best first.
BANDS = ("100%", ">=90%", "<90%")


def subtotals(matches: DataFrame) -> DataFrame:
    """Matched and total words in three classes: equal, at least 90 %, below. Each pair of documents has all three."""
    band = F.when(F.col("rate") == 1, 0).when(F.col("rate") >= 0.9, 1).otherwise(2)
    sums = [F.sum(F.when(band == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i in range(3) for c in ("match_words", "total_words")]
    rows = [F.struct(F.lit(b).alias("band"), F.col(f"match_words{i}").alias("match_words"), F.col(f"total_words{i}").alias("total_words")) for i, b in enumerate(BANDS)]
    return matches.groupBy("src_id", "doc_id").agg(*sums).select("src_id", "doc_id", F.inline(F.array(*rows)))


def details(matches: DataFrame, src_lines: DataFrame) -> DataFrame:
    """Matched lines as shown: line numbers from 1, rate in per cent with two decimals, the head of the source line."""
    src = src_lines.select("src_id", F.col("line_no").alias("src_line"), N.head(F.col("text")).alias("head"))
    matches = matches.persist()
    src = src.join(few(matches.select("src_id", "src_line").distinct()), ["src_id", "src_line"], "left_semi")
    return matches.join(src, ["src_id", "src_line"], "left").select(
        "src_id", "doc_id", (F.col("src_line") + 1).alias("src_no"), (F.col("tgt_line") + 1).alias("tgt_no"), F.round(F.col("rate") * 100, 2).alias("percent"), "match_words", "total_words", F.coalesce("head", F.lit("")).alias("head")
    )


def result_list(ranked: DataFrame, paths: DataFrame) -> DataFrame:
    """The result list: rate in per cent, matches, path, id."""
    return paths.join(few(ranked), "doc_id").select("src_id", F.round(F.col("rate") * 100, 2).alias("percent"), "match_count", "path", "doc_id")


def _order(column: int) -> list[Column]:
    """The result list by one of its columns: rate or count falling, path or id rising."""
    keys = [F.desc("percent"), F.desc("match_count"), F.asc("path"), F.asc("doc_id")]
    return [keys[column], F.asc("src_id"), F.asc("doc_id")]


def positions(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """``rows`` with their place in the whole order, from 1. The rows are dealt out in ranges and counted; a
    range's rows are numbered behind all earlier ranges, so no task sees more than one range. The order must
    leave no ties."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.select("*", F.shiftright("__at", 33).alias("__range"), (F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias("__no")).persist()
    sizes = dealt.groupBy("__range").agg(F.max("__no").alias("n"))
    before = F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__no")).drop("__at", "__range", "__no", "__before")


def listed(results: DataFrame, column: int) -> DataFrame:
    """The result list with the place that each row has when sorted by the column."""
    return positions(results, *_order(column))


def annotated(lines: DataFrame, matches: DataFrame, side: str = "tgt") -> DataFrame:
    """Every line of a document with the rate and colour of its match, if any."""
    key = "doc_id" if side == "tgt" else "src_id"
    other = "src_id" if side == "tgt" else "doc_id"
    m = few(matches.select(key, F.col(f"{side}_line").alias("line_no"), other, "rate"))
    return lines.join(m, [key, "line_no"], "left").select(key, "line_no", other, "rate", colour(F.coalesce("rate", F.lit(0.0))).alias("colour"))


def rescore(matches: DataFrame, src_lines: DataFrame, tgt_lines: DataFrame) -> DataFrame:
    """Character scores in place of word scores: equal pairs count their characters, others are compared anew."""
    matches = matches.persist()
    named = lambda *c: few(matches.select(*c).distinct())
    s = src_lines.select("src_id", F.col("line_no").alias("src_line"), F.col("text").alias("s")).join(named("src_id", "src_line"), ["src_id", "src_line"], "left_semi")
    t = tgt_lines.select("doc_id", F.col("line_no").alias("tgt_line"), F.col("text").alias("t")).join(named("doc_id", "tgt_line"), ["doc_id", "tgt_line"], "left_semi")
    both = matches.join(s, ["src_id", "src_line"], "left").join(t, ["doc_id", "tgt_line"], "left")
    a, b = N.trim_separator(F.coalesce("s", F.lit(""))), N.trim_separator(F.coalesce("t", F.lit("")))
    both = both.withColumn("a", a).withColumn("b", b).withColumn("lcs", S.lcs_chars_arrow("a", "b"))
    match, total, rate = S.char_rate(F.col("a"), F.col("b"), F.col("lcs"))
    equal = F.col("match_words") == F.col("total_words")
    size = F.length(F.coalesce("s", F.lit("")))
    return both.select(
        "src_id", "src_line", "doc_id", "tgt_line",
        F.when(equal, size).otherwise(match).alias("match_chars"), F.when(equal, size).otherwise(total).alias("total_chars"),
        F.when(equal, F.col("rate")).otherwise(rate).alias("rate"),
    )


def backfill(lines: DataFrame, id_col: str, value: str) -> DataFrame:
    """Lines without text take ``value`` from the next line that has some."""
    ahead = W.partitionBy(id_col).orderBy("line_no").rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = F.first(F.when(F.col("text") != "", F.col(value)), ignorenulls=True).over(ahead)
    return lines.withColumn(value, filled)
