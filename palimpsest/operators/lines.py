"""From documents to lines: splitting, segmentation, numeric tables, paragraph groups.

All work inside a row on arrays, so documents are neither shuffled nor sorted; line numbers are array
positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import tokens as T

# Patterns of line starts and of lines that stand alone.
_OPENERS, _CLOSERS = r"(\[<（＜〔【≪《", r")\]>）＞〕】≫》"
NUMERIC_LINE = rf"^[{_OPENERS}][^{_CLOSERS}]+[{_CLOSERS}]$|^[0-9]+$"
NUMERIC_PAGE_LINE = rf"^[{_OPENERS}][^{_CLOSERS}]+[{_CLOSERS}]|^[0-9０-９]+\.?$"
CAPITAL = rf"^{N.BLANK}*[A-Z][^.]"
PLAIN_CAPITAL = rf"^{N.BLANK}*[A-Z]"
TABLE_LINE = r"^[ 0-9+-]+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{N.BLANK}+", ""), f"{N.BLANK}+$", "")


def rows(text: Column) -> Column:
    """Lines of a text as a reader gives them: any line end, and none after the last."""
    feeds = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return N.let(F.split(feeds, "\n"), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def rows_sql(e: str) -> str:
    parts = f"string_split(regexp_replace({e}, '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def sentences(text: Column) -> Column:
    """Lines, cut again where a full stop, a blank and a capital follow one another."""
    return rows(F.regexp_replace(text, r"\. ([A-Z])", ".\n$1"))


def sentences_sql(e: str) -> str:
    return rows_sql(f"regexp_replace({e}, '\\. ([A-Z])', '.' || chr(10) || '\\1', 'g')")


def explode(df: DataFrame, id_col: str, parts: Column) -> DataFrame:
    """``(id, line_no, text)``; null texts have no lines."""
    return df.select(F.col(id_col), F.posexplode(parts).alias("line_no", "text"))


def with_index(lines: DataFrame) -> DataFrame:
    """Adds the index form of each line and its word count."""
    return lines.withColumn("idx", T.split_words(F.col("text"))).withColumn("n_idx_words", T.word_count(F.col("idx")))


def starts_with_capital(line: Column, plain: bool = False) -> Column:
    return line.rlike(PLAIN_CAPITAL) if plain else _trim(line).rlike(NUMERIC_PAGE_LINE) | line.rlike(CAPITAL)


def segment_plain(text: Column) -> Column:
    """The simple segmenter: every normalised line is closed by a line feed when the next begins with a
    capital or it ends in a full stop, else by a blank."""
    parts = F.split(text, "\n")

    def one(raw: Column, i: Column) -> Column:
        line = N.plain_line(F.regexp_replace(raw, f"{N.BLANK}+$", ""))
        end = F.regexp_replace(line, f"{N.BLANK}+$", "")
        after = F.coalesce(F.get(parts, i + 1), F.lit(""))
        return F.concat(line, F.when(starts_with_capital(after, True) | end.endswith(".") | end.endswith("。"), "\n").otherwise(" "))

    return F.array_join(F.transform(parts, one), "")


def segment_plain_sql(e: str) -> str:
    line = N.plain_line_sql(f"regexp_replace(p[i], {N.quote(N.BLANK + '+$')}, '')")
    end = f"regexp_replace({line}, {N.quote(N.BLANK + '+$')}, '')"
    nxt = f"regexp_matches(coalesce(p[i + 1], ''), {N.quote(PLAIN_CAPITAL)})"
    return f"(SELECT array_to_string(list_transform(range(1, len(p) + 1), lambda i: {line} || CASE WHEN {nxt} OR suffix({end}, '.') OR suffix({end}, '。') THEN chr(10) ELSE ' ' END), '') FROM (SELECT string_split({e}, chr(10)) AS p))"


#: The blanks of ``N.BLANK`` one by one, for trimming without a pattern.
SPACE = "\t\n\x0b\x0c\r\x85 \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A text with a line of digits, signs and blanks.
_SOME_TABLE = r"(?:^|\n)[\t-\r\x85\p{Z}+\-0-9]*[+\-0-9][\t-\r\x85\p{Z}+\-0-9]*(?:\n|\z)"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def _run_ends(body: Column) -> Column:
    """``(since, ends)`` of the numeric runs of a text's trimmed lines: the first line that is in one, and the
    last line of each.

    Islands are stretches of numeric or empty lines. A run begins at an island's first numeric line that is
    neither the text's first line nor covered by the run before, and is as many lines long as the island
    has blank-separated pieces from there on, so it may reach beyond the island."""
    numeric = lambda x: x.rlike(TABLE_LINE)

    def of(v: Column) -> Column:
        body, inside, n = v["body"], v["inside"], F.size(v["body"])
        every = F.sequence(F.lit(0), n - 1)
        first = F.filter(every, lambda i: F.get(inside, i) & ~F.coalesce(F.get(inside, i - 1), F.lit(False)))
        last = F.filter(every, lambda i: F.get(inside, i) & ~F.coalesce(F.get(inside, i + 1), F.lit(False)))
        islands = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

        def step(acc: Column, island: Column) -> Column:
            at = F.greatest(acc["upto"], island["first"], F.lit(1))
            begin = F.when(at <= island["last"], F.get(F.filter(F.sequence(at, island["last"]), lambda i: numeric(F.get(body, i))), F.lit(0)))

            def run(i: Column) -> Column:
                rest = F.slice(body, i + 1, island["last"] - i + 1)
                upto = F.aggregate(rest, i, lambda k, x: (k + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int"))
                return N.let(upto, lambda u: F.struct(u.alias("upto"), F.coalesce(acc["since"], i).alias("since"), F.array_append(acc["ends"], u - 1).alias("ends")))

            return N.let(begin, lambda i: F.when(i.isNull(), acc).otherwise(run(i)))

        none = F.struct(F.lit(0).alias("upto"), F.lit(None).cast("int").alias("since"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(islands, none, step, lambda acc: F.struct(acc["since"], acc["ends"]))

    return N.let(F.struct(body.alias("body"), F.transform(body, lambda x: (x == "") | numeric(x)).alias("inside")), of)


def _flags(ends: Column) -> Column:
    """One flag a line up to the last run's end: a run ends here."""
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.flatten(F.zip_with(ends, before, lambda e, p: F.when(e.isNotNull(), F.concat(F.array_repeat(F.lit(False), e - p - 1), F.array(F.lit(True)))).otherwise(F.array().cast("array<boolean>"))))


def _opens(line: Column) -> Column:
    return _strip(line).rlike(NUMERIC_PAGE_LINE) | line.rlike(CAPITAL)


def _broken(line: Column) -> Column:
    """A line cut behind full stops: a new line where what follows opens one, else a blank."""
    parts = F.split(line, r"\.")
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, _strip(p)).otherwise(F.concat(F.when(_opens(p), ".\n").otherwise(". "), _strip(p)))), "")
    return F.when(F.contains(line, F.lit(".")), joined).otherwise(_strip(line))


def segment(text: Column, exclude_tables: bool = False) -> Column:
    """The full segmenter: normalised lines, broken behind full stops, and closed by a line feed or a blank.

    From the first numeric run on, numeric lines are a table: they are kept as they are (or left out), and
    the last line of a run is closed. Everything happens on arrays inside the row."""

    def closed(lines: Column, runs: Column) -> Column:
        since, flags = runs["since"], runs["flags"]

        def one(raw: Column, i: Column) -> Column:
            end = F.when(F.coalesce(F.get(flags, i), F.lit(False)), F.lit("\n")).otherwise(F.lit(""))
            table = F.coalesce(i >= since, F.lit(False))
            made = N.let(N.line(F.rtrim(raw, F.lit(SPACE))), lambda x: F.when(table & x.rlike(TABLE_LINE), end if exclude_tables else F.concat(x, end)).otherwise(x))
            after = F.coalesce(F.get(lines, i + 1), F.lit(""))

            def tail(v: Column) -> Column:
                body, out = v["body"], v["out"]
                stop = F.when(body.endswith(".") & ~_strip(out).endswith("."), ". ").otherwise("")
                feed = _opens(after) | body.rlike(NUMERIC_LINE) | body.endswith(".") | body.endswith("。")
                return F.concat(out, stop, F.when(feed, "\n").when(body != "", " ").otherwise(""))

            return N.let(made, lambda x: N.let(F.struct(_strip(x).alias("body"), _broken(x).alias("out")), tail))

        return F.array_join(F.transform(lines, one), "")

    def of(lines: Column) -> Column:
        none = F.struct(F.lit(None).cast("int").alias("since"), F.array().cast("array<boolean>").alias("flags"))
        runs = N.let(_run_ends(F.transform(lines, _strip)), lambda r: F.struct(r["since"].alias("since"), _flags(r["ends"]).alias("flags")))
        some = F.array_join(lines, "\n").rlike(_SOME_TABLE)
        return N.let(F.when(some, runs).otherwise(none), lambda r: closed(lines, r))

    return N.let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def segment_full(docs: DataFrame, id_col: str, text_col: str = "text", exclude_tables: bool = False) -> DataFrame:
    """``(id, text)`` with segmented texts; a null text gives an empty one."""
    return docs.select(id_col, segment(F.col(text_col), exclude_tables).alias("text"))


def segment_full_sql(source: str, key: str, exclude_tables: bool = False) -> str:
    """DuckDB, line by line: runs by a fold over all numeric lines."""
    space, table = N.quote(SPACE), N.quote(TABLE_LINE)
    opens = lambda e: f"(regexp_matches(trim({e}, {space}), {N.quote(NUMERIC_PAGE_LINE)}) OR regexp_matches({e}, {N.quote(CAPITAL)}))"
    end = "CASE WHEN stops THEN chr(10) ELSE '' END"
    return f"""WITH p AS (SELECT {key}, string_split(coalesce(text, ''), chr(10)) AS p FROM {source}),
l AS (SELECT {key}, unnest(range(len(p)))::INT AS i, unnest(p) AS raw, unnest(list_append(p[2:], '')) AS after FROM p),
t AS (SELECT *, trim(raw, {space}) AS t FROM l),
f AS (SELECT *, regexp_matches(t, {table}) AS num, sum(CASE WHEN t = '' OR regexp_matches(t, {table}) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS island FROM t),
g AS (SELECT *, sum(CASE WHEN t = '' OR num THEN len(string_split(t, ' ')) ELSE 0 END) OVER (PARTITION BY {key}, island ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pieces FROM f),
r AS (SELECT {key}, min(i) AS since, list_reduce(list({{'i': i, 'upto': (i + pieces)::INT}} ORDER BY i), lambda a, x: CASE WHEN a.upto <= x.i THEN {{'upto': x.upto, 'ends': list_append(a.ends, x.upto - 1)}} ELSE a END, {{'upto': 0, 'ends': CAST([] AS INT[])}}).ends AS ends FROM g WHERE num AND i > 0 GROUP BY {key}),
b AS (SELECT l.*, {N.line_sql(f"rtrim(raw, {space})")} AS x, coalesce(i >= since, false) AS inside, coalesce(list_contains(ends, i), false) AS stops FROM l LEFT JOIN r USING ({key})),
c AS (SELECT *, CASE WHEN inside AND regexp_matches(x, {table}) THEN {end if exclude_tables else f"x || {end}"} ELSE x END AS y FROM b),
o AS (SELECT *, trim(y, {space}) AS body, CASE WHEN contains(y, '.') THEN array_to_string(list_transform(string_split(y, '.'), lambda s, j: CASE WHEN j = 1 THEN '' WHEN {opens('s')} THEN '.' || chr(10) ELSE '. ' END || trim(s, {space})), '') ELSE trim(y, {space}) END AS out FROM c)
SELECT {key}, string_agg(out || CASE WHEN suffix(body, '.') AND NOT suffix(trim(out, {space}), '.') THEN '. ' ELSE '' END
  || CASE WHEN {opens('after')} OR regexp_matches(body, {N.quote(NUMERIC_LINE)}) OR suffix(body, '.') OR suffix(body, '。') THEN chr(10) WHEN body <> '' THEN ' ' ELSE '' END, '' ORDER BY i) AS text FROM o GROUP BY {key}"""


def numeric_runs(lines: DataFrame, id_col: str) -> DataFrame:
    """``(id, first_line, n_lines, n_pieces)`` of each maximal run of numeric or empty lines that has a numeric one."""
    t = F.trim("text")
    w = W.partitionBy(id_col).orderBy("line_no")
    flagged = lines.select(id_col, "line_no", t.alias("t"), (t.rlike(TABLE_LINE) | (t == "")).alias("in"))
    island = flagged.withColumn("island", F.sum(F.when(F.col("in"), 0).otherwise(1)).over(w)).filter("in")
    out = island.groupBy(id_col, "island").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.size(F.split("t", " "))).alias("n_pieces"), F.max(F.col("t") != "").alias("any")
    )
    return out.filter("any").select(id_col, "first_line", "n_lines", "n_pieces")


def paragraph_groups(text: Column, mark: str = "  ") -> Column:
    """Lines of one text as ``(line_no, text, group)``: a line that ends with ``mark`` goes on in the next."""
    parts = rows(text)
    step = lambda acc, x: F.struct(
        F.array_append(acc["groups"], F.when(acc["open"], F.element_at(acc["groups"], -1)).otherwise(F.coalesce(F.try_element_at(acc["groups"], F.lit(-1)) + 1, F.lit(0)))).alias("groups"),
        x.endswith(mark).alias("open"),
    )
    init = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(False).alias("open"))
    return F.aggregate(parts, init, step, lambda acc: acc["groups"])


def rejoin(lines: DataFrame, id_col: str) -> DataFrame:
    """Lines back to one text each, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
