"""Registered queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity as S
from ..functions import symbols as Y
from ..functions import tokens as T
from ..operators import lines as L
from ..operators import locate as P
from ..operators import matching as M
from ..operators import report as R
from ..operators import rough
from ..sources import corpus as C
from ..sources.index import LineIndex
from ..sources.work import work_path

PARAMS = M.SearchParams(rate=0.6, min_words=5)
ROUGH = 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode(table(spark, sf_dir, "documents"), "doc_id", L.sentences(F.col("text")))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("src_id"), "text")


def _lines_sql(source: str, key: str, name: str, parts: Callable[[str], str] = L.sentences_sql) -> str:
    return f"(SELECT {name}, unnest(range(len(p)))::INT AS line_no, unnest(p) AS text FROM (SELECT {key} AS {name}, {parts('text')} AS p FROM {source}))"


_DOC = _lines_sql("documents", "doc_id", "doc_id")
_SRC = _lines_sql("benchmark", "item_id", "src_id")


# ---- scans and line splitting -------------------------------------------------------------


def _path(url: Column, n: Column) -> Column:
    """Page addresses made into file paths of all kinds."""
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".DOCX", ".pdf", ".png", ".doc"))), (n % 5 + 1).cast("int"))
    folder = F.when(n % 7 == 0, "/.index/").when(n % 11 == 0, "/.hidden/").otherwise("/d/")
    name = F.when(n % 13 == 0, ".f").otherwise("f")
    return F.concat(F.regexp_extract(url, "^https?://([^/]+)", 1), folder, name, n.cast("string"), ext)


_PATH_SQL = """(SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) || CASE WHEN page_id % 7 = 0 THEN '/.index/' WHEN page_id % 11 = 0 THEN '/.hidden/' ELSE '/d/' END
  || CASE WHEN page_id % 13 = 0 THEN '.f' ELSE 'f' END || page_id || (['.txt', '.DOCX', '.pdf', '.png', '.doc'])[page_id % 5 + 1] AS path FROM pages)"""


@query(f"SELECT page_id, path FROM {_PATH_SQL} WHERE regexp_matches(lower(path), '\\.(txt|doc|docx|pdf)$') AND NOT contains(path, '.index') AND NOT regexp_matches(path, '(^|/)\\.[^/]*$') AND NOT regexp_matches(path, '(^|/)\\.[^/]*/[^/]*$')")
def corpus_scan_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", _path(F.col("url"), F.col("page_id")).alias("path"))
    return pages.filter(C.wanted(F.col("path")))


@query("SELECT * FROM " + _lines_sql("documents", "doc_id", "doc_id", L.rows_sql))
def doc_lines(spark, sf_dir):
    return L.explode(table(spark, sf_dir, "documents"), "doc_id", L.rows(F.col("text")))


@query(f"SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM {_DOC} GROUP BY doc_id")
def rejoin_text(spark, sf_dir):
    return L.rejoin(doc_lines_of(spark, sf_dir), "doc_id")


@query(f"SELECT src_id, count(*) AS line_count, sum(length(text))::BIGINT AS char_count FROM {_SRC} WHERE text <> '' GROUP BY src_id")
def src_totals(spark, sf_dir):
    return R.source_totals(L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text"))), "src_id")


@query(f"SELECT doc_id, count(*) AS line_count, sum(length(text))::BIGINT AS char_count FROM {_DOC} WHERE text <> '' GROUP BY doc_id")
def doc_totals(spark, sf_dir):
    return R.source_totals(doc_lines_of(spark, sf_dir), "doc_id")


@query("SELECT page_id, array_to_string(list_filter(string_split(html, chr(10)), lambda x: x <> ''), chr(10)) AS text FROM pages")
def join_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.join_paragraphs(F.split("html", "\n")).alias("text"))


# ---- normalisation ------------------------------------------------------------------------

#: Characters that the tables lack, put at the end of each text so that every rule has work.
_SPICE = " x’y“z—w™v\tu Fig. 3 is.  ＡＢ　ｶﾞα∆(∀)。終"


def _spiced(c: str) -> Column:
    return F.concat(F.col(c), F.lit(_SPICE))


def _spiced_sql(c: str) -> str:
    return f"({c} || {N.quote(_SPICE)})"


def _rules(name: str, rules: N.Rules, source: str, key: str, col: str) -> None:
    def f(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, N.apply(_spiced(col), rules).alias("text"))

    f.__name__ = name
    query(f"SELECT {key}, {N.sql(_spiced_sql(col), rules)} AS text FROM {source}")(f)


for _name, _r, _s, _k, _c in (
    ("norm_controls", N.CONTROLS, "documents", "doc_id", "text"),
    ("norm_spaces", N.SPACES + N.COLLAPSE, "pages", "page_id", "html"),
    ("norm_quotes", N.QUOTES, "documents", "doc_id", "text"),
    ("norm_fig", N.FIGURE, "documents", "doc_id", "text"),
    ("norm_field_code", N.FIELD_CODE, "pages", "page_id", "html"),
    ("norm_breaks", N.PLAIN_PERIOD + N.FULL_STOP_BREAK, "benchmark", "item_id", "text"),
):
    _rules(_name, _r, _s, _k, _c)


@query(f"SELECT doc_id, translate({_spiced_sql('text')}, {N.quote(N.WIDE)}, {N.quote(N.NARROW)}) AS text FROM documents")
def zen_to_han(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.zen_to_han(_spiced("text")).alias("text"))


@query(f"SELECT doc_id, translate({_spiced_sql('text')}, {N.quote(N.HALF_KANA)}, {N.quote(N.FULL_KANA)}) AS text FROM documents")
def han_to_zen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.han_to_zen(_spiced("text")).alias("text"))


def _marked(c: str) -> Column:
    n = F.col("line_no").cast("string")
    return F.when(F.col("line_no") % 3 == 0, F.concat(F.lit(" ("), n, F.lit(") "), F.col(c))).when(F.col("line_no") % 3 == 1, F.concat(n, F.lit(". "), F.col(c))).otherwise(F.concat(F.lit("【"), n, F.lit("】"), F.col(c)))


_MARKED_SQL = "CASE line_no % 3 WHEN 0 THEN ' (' || line_no || ') ' || text WHEN 1 THEN line_no || '. ' || text ELSE '【' || line_no || '】' || text END"


@query(f"SELECT src_id, line_no, {N.sql(_MARKED_SQL, N.BRACKET_LINE + N.BRACKET_NUMBER)} AS text FROM {_SRC}")
def bracket_lines(spark, sf_dir):
    lines = L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text")))
    return lines.select("src_id", "line_no", N.apply(_marked("text"), N.BRACKET_LINE + N.BRACKET_NUMBER).alias("text"))


@query(f"SELECT doc_id, line_no, {N.sql(_MARKED_SQL, N.NUMBER_LINE)} AS text FROM {_DOC}")
def numbered_lines(spark, sf_dir):
    return doc_lines_of(spark, sf_dir).select("doc_id", "line_no", N.apply(_marked("text"), N.NUMBER_LINE).alias("text"))


@query(f"SELECT doc_id, line_no, {N.line_sql('text')} AS text FROM {_DOC}")
def norm_line(spark, sf_dir):
    return doc_lines_of(spark, sf_dir).select("doc_id", "line_no", N.line(F.col("text")).alias("text"))


@query(f"SELECT src_id, line_no, array_to_string({N.converter_lines_sql(_MARKED_SQL)}, '|') AS text FROM {_SRC}")
def norm_converter(spark, sf_dir):
    lines = L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text")))
    return lines.select("src_id", "line_no", F.array_join(N.converter_lines(_marked("text")), "|").alias("text"))


@query(f"SELECT doc_id, {N.strip_all_sql(_spiced_sql('text'))} AS text FROM documents")
def strip_symbols(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.strip_all(_spiced("text")).alias("text"))


_ENDED = "CASE line_no % 3 WHEN 0 THEN text || ')  ' WHEN 1 THEN text || '.  ' ELSE text END"


def _ended() -> Column:
    return F.when(F.col("line_no") % 3 == 0, F.concat("text", F.lit(")  "))).when(F.col("line_no") % 3 == 1, F.concat("text", F.lit(".  "))).otherwise(F.col("text"))


@query(f"SELECT doc_id, line_no, {N.trim_separator_sql('e')} AS trimmed, CASE WHEN length(e) > 3 AND suffix(e, '.  ') THEN e WHEN length(e) > 3 AND regexp_matches(e, {N.quote(N.CLOSED)}) THEN regexp_replace(e, {N.quote(N.BLANK + '+$')}, '') ELSE e || chr(10) END AS shown FROM (SELECT doc_id, line_no, {_ENDED} AS e FROM {_DOC})")
def line_ends(spark, sf_dir):
    lines = doc_lines_of(spark, sf_dir).select("doc_id", "line_no", _ended().alias("e"))
    return lines.select("doc_id", "line_no", N.trim_separator(F.col("e")).alias("trimmed"), N.display_feed(F.col("e")).alias("shown"))


@query("SELECT doc_id, substr(text, 1, 500) AS head, substr(text, 101, 50) AS middle, '' AS beyond FROM documents")
def text_slices(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", N.head(t).alias("head"), N.safe_substring(t, F.lit(100), F.lit(50)).alias("middle"), N.safe_substring(t, F.length(t) + 5).alias("beyond"))


#: A blank before or behind a dash between blanks stays as it is: such blanks are marked on both sides, and the
#: parts between marks are collapsed.
_GAP = "[\\t\\x0B\\f\\x85\\p{Z}]"
_DASHED = "text || '   x  -   y - - z  -- '"
for _from, _to in ((f"({_GAP})-([\\t-\\r\\x85\\p{{Z}}])", "\x01\\1\x01-\\2"), (f"({_GAP})-([\\t-\\r\\x85\\p{{Z}}])", "\x01\\1\x01-\\2"), (f"([\\t-\\r\\x85\\p{{Z}}]\x01?-)({_GAP})", "\\1\x01\\2\x01")):
    _DASHED = f"regexp_replace({_DASHED}, {N.quote(_from)}, {N.quote(_to)}, 'g')"
_DASHED = f"array_to_string(list_transform(string_split({_DASHED}, '\x01'), lambda x, i: CASE WHEN i % 2 = 0 THEN x ELSE regexp_replace(x, '{_GAP}+', ' ', 'g') END), '')"


@query(f"SELECT doc_id, line_no, regexp_replace(text, '^[\\t-\\r\\x85\\p{{Z}}]+|[\\t-\\r\\x85\\p{{Z}}]+$', '', 'g') AS text FROM (SELECT doc_id, line_no, {_DASHED} AS text FROM {_DOC})")
def cleanup_text(spark, sf_dir):
    return doc_lines_of(spark, sf_dir).select("doc_id", "line_no", N.cleanup(F.concat("text", F.lit("   x  -   y - - z  -- "))).alias("text"))


_CODES_SQL = "(SELECT page_id, upper(printf('%x', 61472 + page_id % 120)) AS code FROM pages)"


@query(f"SELECT page_id, code, CASE WHEN page_id % 120 < {len(Y.PRIVATE_TO)} THEN substr({N.quote(Y.PRIVATE_TO)}, (page_id % 120 + 1)::INT, 1) ELSE ' ' END AS shown, translate(html || '∆', {N.quote(Y.SYMBOL_FONT + '∆')}, {N.quote(Y.SYMBOL_FONT_TO + 'Δ')}) AS greek FROM {_CODES_SQL} JOIN pages USING (page_id)")
def symbol_chars(spark, sf_dir):
    code = F.hex(F.lit(0xF020) + F.col("page_id") % 120)
    return table(spark, sf_dir, "pages").select("page_id", code.alias("code"), Y.from_symbol_code(code).alias("shown"), Y.from_symbol_font(F.concat("html", F.lit("∆"))).alias("greek"))


# ---- tokens -------------------------------------------------------------------------------

_JP = "患者のデータを、すーぱーで。Größe a b."


@query("SELECT doc_id, " + ", ".join(f"(length(t) - length(regexp_replace(t, '[{c}]', '', 'g')))::INT AS {n}" for n, c in T.CLASSES.items()) + f", regexp_matches(t, '[{T.HIRAGANA}{T.KATAKANA}{T.KANJI}]') AS japanese FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || {N.quote(_JP)} ELSE text END AS t FROM documents)")
def char_class_counts(spark, sf_dir):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(_JP))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", *[T.count_of(F.col("t"), n).cast("int").alias(n) for n in T.CLASSES], T.is_japanese(F.col("t")).alias("japanese"))


@query(f"SELECT doc_id, line_no, {T.split_words_sql('t')} AS idx FROM (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN text || {N.quote(_JP)} ELSE text END AS t FROM {_DOC})")
def split_words(spark, sf_dir):
    t = F.when(F.col("line_no") % 2 == 0, F.concat("text", F.lit(_JP))).otherwise(F.col("text"))
    return doc_lines_of(spark, sf_dir).select("doc_id", "line_no", T.split_words(t).alias("idx"))


@query(f"SELECT doc_id, line_no, len(string_split({T.split_words_sql('text')}, ' '))::INT AS n FROM {_DOC}")
def index_word_count(spark, sf_dir):
    return doc_lines_of(spark, sf_dir).select("doc_id", "line_no", T.word_count(T.split_words(F.col("text"))).alias("n"))


@query(f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, text, {T.split_words_sql('text')} AS idx FROM {_DOC}) WHERE text <> '' AND idx <> '' AND len(string_split(idx, ' ')) >= {PARAMS.min_words}")
def min_words_filter(spark, sf_dir):
    return M.eligible(M.line_table(table(spark, sf_dir, "documents"), "doc_id"), PARAMS).select("doc_id", "line_no")


# ---- segmentation -------------------------------------------------------------------------


@query(f"SELECT doc_id, {L.segment_plain_sql('text')} AS text FROM documents")
def segment_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.segment_plain(F.col("text")).alias("text"))


@query(L.segment_full_sql("documents", "doc_id"))
def segment_full(spark, sf_dir):
    return L.segment_full(table(spark, sf_dir, "documents"), "doc_id")


#: Documents with rows of numbers between their lines, some with more pieces than the run has lines.
_TABLES_SQL = "(SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1 + doc_id) % 7 IN (2, 3) THEN ' 1  -2 ' || (i - 1) WHEN (i - 1 + doc_id) % 7 = 4 THEN (i - 1)::VARCHAR WHEN (i - 1 + doc_id) % 7 = 5 THEN ' ' ELSE x END), chr(10)) AS text FROM documents)"


def _tables(spark, sf_dir) -> DataFrame:
    k = lambda i: (i + F.col("doc_id")) % 7
    made = F.transform(F.split("text", "\n"), lambda x, i: F.when(k(i).isin(2, 3), F.concat(F.lit(" 1  -2 "), i.cast("string"))).when(k(i) == 4, i.cast("string")).when(k(i) == 5, F.lit(" ")).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(made, "\n").alias("text"))


@query(L.segment_full_sql(_TABLES_SQL, "doc_id"))
def segment_tables(spark, sf_dir):
    return L.segment_full(_tables(spark, sf_dir), "doc_id")


@query(L.segment_full_sql(_TABLES_SQL, "doc_id", True))
def segment_without_tables(spark, sf_dir):
    return L.segment_full(_tables(spark, sf_dir), "doc_id", exclude_tables=True)


_NUM_SQL = "(SELECT conv_id, turn::INT AS line_no, CASE WHEN turn % 4 IN (1, 2) THEN '1 2 ' || turn WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations)"


@query(f"""WITH f AS (SELECT conv_id, line_no, trim(text) AS t, regexp_matches(trim(text), '^[ 0-9+-]+$') OR trim(text) = '' AS i FROM {_NUM_SQL}),
g AS (SELECT *, sum(CASE WHEN i THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY line_no) AS island FROM f)
SELECT conv_id, min(line_no) AS first_line, count(*) AS n_lines, sum(len(string_split(t, ' ')))::BIGINT AS n_pieces FROM g WHERE i GROUP BY conv_id, island HAVING bool_or(t <> '')""")
def numeric_runs(spark, sf_dir):
    k = F.col("turn") % 4
    text = F.when(k.isin(1, 2), F.concat(F.lit("1 2 "), F.col("turn").cast("string"))).when(k == 3, "").otherwise(F.col("text"))
    return L.numeric_runs(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("line_no"), text.alias("text")), "conv_id")


_GLUED_SQL = "(SELECT doc_id, replace(text, '.' || chr(10), '  ' || chr(10)) AS text FROM documents)"


@query(f"""WITH l AS {_lines_sql(_GLUED_SQL, 'doc_id', 'doc_id', L.rows_sql)},
o AS (SELECT *, lag(suffix(text, '  '), 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS open FROM l)
SELECT doc_id, line_no, (sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS "group" FROM o""")
def paragraph_groups(spark, sf_dir):
    glued = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(".\n"), F.lit("  \n")).alias("text"))
    return glued.select("doc_id", F.posexplode(L.paragraph_groups(F.col("text"))).alias("line_no", "group"))


# ---- similarity of neighbouring lines -----------------------------------------------------


def _pairs(spark, sf_dir, name: str, key: str, each: Callable[[Column], Column] | None = None) -> DataFrame:
    """Neighbouring lines; ``each`` is done to a line once, though it stands in two pairs."""
    p = L.sentences(F.col("text"))
    docs = table(spark, sf_dir, name).select(key, p.alias("p")).filter(F.size("p") > 1)
    docs = docs.withColumn("p", F.transform("p", each)) if each else docs
    zipped = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct((i - 1).cast("int").alias("line_no"), F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    return docs.select(key, F.inline(zipped))


def _pairs_sql(source: str, key: str) -> str:
    return f"(SELECT {key}, unnest(range(len(p) - 1))::INT AS line_no, unnest(p[:-2]) AS a, unnest(p[2:]) AS b FROM (SELECT {key}, {L.sentences_sql('text')} AS p FROM {source}) WHERE len(p) > 1)"


_CONV, _ITEM = "(SELECT conv_id * 100 + turn AS id, text FROM conversations)", "(SELECT item_id AS id, text FROM benchmark)"


def _conv_pairs(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), L.sentences(F.col("text")).alias("p"))
    zipped = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct((i - 1).cast("int").alias("line_no"), F.element_at("p", i).alias("a"), F.element_at("p", i + 1).alias("b")))
    return conv.filter(F.size("p") > 1).select("id", F.inline(zipped))


def lcs_sql(a: str, b: str, same: str = "{b}[j] = w") -> str:
    """Row-by-row table of the longest common subsequence with nested folds."""
    cell = f"greatest(CASE WHEN {same.format(b=b)} THEN prev[j] + 1 ELSE 0 END, prev[j + 1], acc[j])"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce({a}, lambda prev, w: list_reduce(range(1, len({b}) + 1), lambda acc, j: list_append(acc, {cell}), [0::BIGINT]), list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT))[-1] END"


@query(f"""WITH p AS (SELECT id, line_no, {T.pieces_sql('a')} AS x, {T.pieces_sql('b')} AS y FROM {_pairs_sql(_CONV, 'id')}), m AS (SELECT *, {lcs_sql('x', 'y')} AS l FROM p)
SELECT id, line_no, l::INT AS match, greatest(len(x), len(y))::INT AS total, l / nullif(greatest(len(x), len(y)), 0)::DOUBLE AS rate FROM m""")
def line_similarity(spark, sf_dir):
    p = _conv_pairs(spark, sf_dir).select("id", "line_no", T.pieces(F.col("a")).alias("x"), T.pieces(F.col("b")).alias("y")).withColumn("l", S.lcs_arrow("x", "y"))
    match, total, rate = S.word_rate(F.col("x"), F.col("y"), F.col("l"))
    return p.select("id", "line_no", match.cast("int").alias("match"), total.cast("int").alias("total"), rate.alias("rate"))


@query(f"""WITH p AS (SELECT id, line_no, a, b, list_filter(string_split(a, ''), lambda c: c <> '') AS x, list_filter(string_split(b, ''), lambda c: c <> '') AS y FROM (SELECT id, line_no, {N.trim_separator_sql('a')} AS a, {N.trim_separator_sql('b')} AS b FROM {_pairs_sql(_ITEM, 'id')})), m AS (SELECT *, {lcs_sql('x', 'y')} AS l FROM p)
SELECT id, line_no, greatest(2 * l - length(b), 0)::INT AS match, length(a)::INT AS total, greatest(2 * l - length(b), 0) / nullif(length(a), 0)::DOUBLE AS rate FROM m""")
def char_similarity(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), L.sentences(F.col("text")).alias("p"))
    zipped = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct((i - 1).cast("int").alias("line_no"), N.trim_separator(F.element_at("p", i)).alias("a"), N.trim_separator(F.element_at("p", i + 1)).alias("b")))
    p = items.filter(F.size("p") > 1).select("id", F.inline(zipped)).withColumn("l", S.lcs_chars_arrow("a", "b"))
    match, total, rate = S.char_rate(F.col("a"), F.col("b"), F.col("l"))
    return p.select("id", "line_no", match.cast("int").alias("match"), total.cast("int").alias("total"), rate.alias("rate"))


@query(f"""WITH p AS (SELECT id, line_no, {T.pieces_sql(N.strip_all_sql('a'))} AS x, {T.pieces_sql(N.strip_all_sql('b'))} AS y FROM {_pairs_sql(_CONV, 'id')}), m AS (SELECT *, {lcs_sql('x', 'y', 'starts_with({b}[j], w) OR starts_with(w, {b}[j])')} AS l FROM p)
SELECT id, line_no, l::INT AS match, len(x)::INT AS words, CASE WHEN len(x) = 0 THEN len(y) = 0 ELSE l / len(x)::DOUBLE >= 0.8 END AS alike FROM m""")
def prefix_lcs(spark, sf_dir):
    match, words, alike = S.prefix_lcs(F.col("a"), F.col("b"))
    return _conv_pairs(spark, sf_dir).select("id", "line_no", match.cast("int").alias("match"), words.cast("int").alias("words"), alike.alias("alike"))


_BARE = "regexp_replace({}, '[\\t-\\r\\x85\\p{{Z}}]+', '', 'g')"


@query(f"WITH p AS (SELECT doc_id, line_no, {_BARE.format(N.strip_all_sql('a'))} AS x, {_BARE.format(N.strip_all_sql('b'))} AS y FROM {_pairs_sql('documents', 'doc_id')}) SELECT doc_id, line_no, contains(x, y) OR contains(y, x) AS inside FROM p")
def containment(spark, sf_dir):
    return _pairs(spark, sf_dir, "documents", "doc_id", N.bare).select("doc_id", "line_no", S.either_in(F.col("a"), F.col("b")).alias("inside"))


@query(f"""WITH p AS (SELECT id, line_no, {_BARE.format('a')} AS x, {_BARE.format('b')} AS y FROM {_pairs_sql(_ITEM, 'id')}),
s AS (SELECT id, line_no, y, length(x) AS n, unnest(range(1, length(x) + 1)) AS i, x FROM p), c AS (SELECT id, line_no, max(k) AS best FROM (SELECT id, line_no, unnest(range(1, (n - i + 2)::BIGINT)) AS k, x, y, i FROM s) WHERE contains(y, substr(x, i, k)) GROUP BY ALL)
SELECT id, line_no, coalesce(best, 0)::INT AS size FROM p LEFT JOIN c USING (id, line_no)""")
def common_substring(spark, sf_dir):
    return _pairs(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("id"), "line_no", S.common_substring_arrow("a", "b").alias("size"))


_BARE_CHAR = _BARE.format(N.strip_all_sql("substr(@, i, 1)"))
_KEPT_SQL = f"list_filter(range(1, length(@) + 1), lambda i: {_BARE_CHAR} <> '')"
_FOLD_SQL = f"array_to_string(list_transform(range(1, length(@) + 1), lambda i: {_BARE_CHAR}), '')"


def _begins_sql(whole: str, part: str, text: str) -> str:
    """Offset of ``part`` in ``whole`` if its longest beginning found there is long enough."""
    most = f"len(list_filter(range(1, length(f{part}) + 1), lambda k: contains(f{whole}, substr(f{part}, 1, k))))"
    return f"""list_transform([{most}], lambda m: CASE WHEN m > 0 AND CASE WHEN m = length(f{part}) THEN length({text}) ELSE k{part}[m + 1] - 1 END >= best AND k{whole}[strpos(f{whole}, substr(f{part}, 1, m))] >= k{part}[1]
    THEN k{whole}[strpos(f{whole}, substr(f{part}, 1, m))] - k{part}[1] END)[1]"""


@query(ORACLES["common_substring"].replace("WITH p AS (SELECT id, line_no,", "WITH p AS (SELECT id, line_no, a, b,").split("SELECT id, line_no, coalesce(best, 0)")[0] + f""", f AS (SELECT p.id AS item_id, p.line_no, a, b, coalesce(best, 0) AS best, {_FOLD_SQL.replace('@', 'a')} AS fx, {_FOLD_SQL.replace('@', 'b')} AS fy, {_KEPT_SQL.replace('@', 'a')} AS kx, {_KEPT_SQL.replace('@', 'b')} AS ky FROM p LEFT JOIN c USING (id, line_no))
SELECT item_id, line_no, coalesce({_begins_sql('x', 'y', 'b')}, -({_begins_sql('y', 'x', 'a')}))::INT AS "offset" FROM f""")
def overlap_offset(spark, sf_dir):
    return _pairs(spark, sf_dir, "benchmark", "item_id").select("item_id", "line_no", S.overlap_offset_arrow("a", "b").alias("offset"))


# ---- matching -----------------------------------------------------------------------------


def matched(spark: SparkSession, sf_dir: str, params: M.SearchParams = PARAMS) -> DataFrame:
    """Accepted line matches of all benchmark items in all documents."""
    src, tgt = M.line_table(bench(spark, sf_dir), "src_id"), M.line_table(table(spark, sf_dir, "documents"), "doc_id")
    return M.greedy(M.similarity_join(M.eligible(src, params), tgt, params))


def _match_sql(src: str = _SRC, doc: str = _DOC, where: str = "", only: str = "", params: M.SearchParams = PARAMS) -> str:
    """CTEs up to ``matches``: overlap counts of numbered pieces bound the rate; the rest is scored and assigned.
    ``where`` limits the lines, ``only`` the pairs."""
    t, pieces = params.rate, T.pieces_sql(T.split_words_sql('text') if params.is_jp else 'text')
    line = lambda src, key: f"SELECT {key}, line_no, idx, w, len(w) AS n FROM (SELECT {key}, line_no, {T.split_words_sql('text')} AS idx, {pieces} AS w, text FROM {src}) WHERE text <> '' AND idx <> ''{where}"
    num = lambda src, key: f"SELECT {key}, line_no, n, p, row_number() OVER (PARTITION BY {key}, line_no, p) AS k FROM (SELECT {key}, line_no, n, unnest(w) AS p FROM {src})"
    fold = "list_reduce(pairs, lambda s, x: CASE WHEN len(list_filter(s, lambda y: y.src_line = x.src_line OR y.tgt_line = x.tgt_line)) > 0 THEN s ELSE list_append(s, x) END, CAST([] AS STRUCT(src_line INT, tgt_line INT, match_words INT, total_words INT, rate DOUBLE)[]))"
    return f"""sl AS ({line(src, 'src_id')}), el AS (SELECT * FROM sl WHERE len(string_split(idx, ' ')) >= {params.min_words}), tl AS ({line(doc, 'doc_id')}),
sn AS ({num('el', 'src_id')}), tn AS ({num('tl', 'doc_id')}),
ov AS (SELECT src_id, sn.line_no AS src_line, doc_id, tn.line_no AS tgt_line FROM sn JOIN tn USING (p, k)
  WHERE least(sn.n, tn.n) >= {t} * greatest(sn.n, tn.n) - 1e-9 GROUP BY ALL HAVING count(*) >= {t} * greatest(max(sn.n), max(tn.n)) - 1e-9),
sc AS (SELECT ov.src_id, src_line, ov.doc_id, tgt_line, el.w AS x, tl.w AS y FROM ov JOIN el ON el.src_id = ov.src_id AND el.line_no = src_line JOIN tl ON tl.doc_id = ov.doc_id AND tl.line_no = tgt_line),
lc AS (SELECT *, {lcs_sql('x', 'y')} AS l, greatest(len(x), len(y)) AS n FROM sc),
sim AS (SELECT src_id, src_line, doc_id, tgt_line, l::INT AS match_words, n::INT AS total_words, l / n::DOUBLE AS rate FROM lc WHERE l / n::DOUBLE >= {t}{only}),
grp AS (SELECT src_id, doc_id, list(struct_pack(src_line, tgt_line, match_words, total_words, rate) ORDER BY src_line, tgt_line) AS pairs FROM sim GROUP BY ALL),
matches AS (SELECT src_id, doc_id, m.src_line, m.tgt_line, m.match_words, m.total_words, m.rate FROM (SELECT src_id, doc_id, unnest({fold}) AS m FROM grp)),
totals AS (SELECT src_id, count(*)::INT AS total FROM el GROUP BY src_id),
ranked AS (SELECT src_id, doc_id, count(*)::INT AS match_count, max(total) AS total, count(*) / max(total)::DOUBLE AS rate FROM matches JOIN totals USING (src_id) GROUP BY ALL)"""


_M = "WITH " + _match_sql()


@query(f"{_M} SELECT * FROM sim")
def similarity_join(spark, sf_dir):
    src, tgt = M.line_table(bench(spark, sf_dir), "src_id"), M.line_table(table(spark, sf_dir, "documents"), "doc_id")
    return M.similarity_join(M.eligible(src, PARAMS), tgt, PARAMS)


@query(f"{_M} SELECT * FROM matches")
def greedy_match(spark, sf_dir):
    return matched(spark, sf_dir)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matched_rank(matched(spark, sf_dir), M.totals(M.line_table(bench(spark, sf_dir), "src_id"), PARAMS))


@query(f"{_M} SELECT i.item_id AS src_id, d.doc_id, coalesce(match_count, 0) AS match_count, coalesce(totals.total, 0) AS total, coalesce(ranked.rate, 0.0) AS rate FROM documents d CROSS JOIN benchmark i LEFT JOIN ranked ON ranked.src_id = i.item_id AND ranked.doc_id = d.doc_id LEFT JOIN totals ON totals.src_id = i.item_id")
def doc_rank(spark, sf_dir):
    """The whole stated set of sources against all documents, with the zero rows."""
    sources, docs = bench(spark, sf_dir), table(spark, sf_dir, "documents")
    src = M.line_table(sources, "src_id")
    found = M.greedy(M.similarity_join(M.eligible(src, PARAMS), M.line_table(docs, "doc_id"), PARAMS))
    return M.rank(found, sources.select("src_id"), M.totals(src, PARAMS), docs)


@query(f"{_M} SELECT * FROM ranked")
def search_documents(spark, sf_dir):
    return ranked(spark, sf_dir)


_ITEM_TABLES_SQL = "(SELECT item_id, '12 34' || chr(10) || text || chr(10) || '1 2 3 4 5 6 7' || chr(10) || item_id || ' +2 -3 4 5 6' AS text FROM benchmark)"
_NO_TABLE = f" AND NOT (line_no > 0 AND regexp_matches(trim(text), {N.quote(L.TABLE_LINE)}))"


@query(f"WITH {_match_sql(_lines_sql(_ITEM_TABLES_SQL, 'item_id', 'src_id'), _lines_sql(_TABLES_SQL, 'doc_id', 'doc_id'), _NO_TABLE)} SELECT * FROM ranked")
def search_without_tables(spark, sf_dir):
    """Items with rows of numbers searched in documents with such rows: they neither match nor count."""
    from dataclasses import replace

    n = F.col("item_id").cast("string")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("src_id"), F.concat(F.lit("12 34\n"), "text", F.lit("\n1 2 3 4 5 6 7\n"), n, F.lit(" +2 -3 4 5 6")).alias("text"))
    return M.search(items, _tables(spark, sf_dir), replace(PARAMS, exclude_tables=True))[1]


@query(f"""WITH {_match_sql().split("sn AS (")[0].rstrip().rstrip(",")}, a AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY line_no) AS k FROM el), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM tl),
z AS (SELECT src_id, doc_id, a.w AS x, b.w AS y FROM a JOIN b USING (k)), t AS (SELECT src_id, count(*)::INT AS total FROM el GROUP BY src_id)
SELECT src_id, doc_id, count(*)::INT AS match_count, max(total) AS total, count(*) / max(total)::DOUBLE AS rate FROM z JOIN t USING (src_id) WHERE len(list_intersect(x, y)) > 0 GROUP BY ALL""")
def search_accepting_zero(spark, sf_dir):
    """At rate 0 every pair of lines qualifies: lines are taken in order, and those that share a word count."""
    from dataclasses import replace

    return M.search(bench(spark, sf_dir), table(spark, sf_dir, "documents"), replace(PARAMS, rate=0.0, accept_zero=True))[1]


#: The searches of a queue: (language of the documents, settings).
_ASKED = (("en", M.SearchParams(0.6, 5)), ("de", M.SearchParams(0.4, 3, True)), ("fr", M.SearchParams(1.0, 8)), ("es", PARAMS))


def _asked_sql(k: int, lang: str, params: M.SearchParams) -> str:
    docs = _lines_sql(f"(SELECT doc_id, text FROM documents WHERE lang = '{lang}')", "doc_id", "doc_id")
    return f"SELECT src_id * {len(_ASKED)} + {k} AS request_id, doc_id, match_count, total, rate FROM (WITH {_match_sql(doc=docs, params=params)} SELECT * FROM ranked)"


@query(" UNION ALL ".join(_asked_sql(k, lang, params) for k, (lang, params) in enumerate(_ASKED)))
def queue_search(spark, sf_dir):
    """Every item searched in four languages, each time with other settings, in one pass."""
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lang).alias("scope"), F.lit(p.is_jp).alias("is_jp"), F.lit(p.rate).alias("rate"), F.lit(p.min_words).alias("min_words")) for k, (lang, p) in enumerate(_ASKED)])
    sources = bench(spark, sf_dir)
    queue = sources.select("src_id", F.inline(asked)).withColumn("request_id", F.col("src_id") * len(_ASKED) + F.col("k"))
    return M.search_queue(sources, table(spark, sf_dir, "documents").withColumnRenamed("lang", "scope"), queue)[1]


_LEVEL = "least(9, greatest(0, ceil((1 - rate) * 10)::INT))"


@query(f"{_M} SELECT src_id, {_LEVEL} AS level, sum(match_words)::BIGINT AS words FROM matches GROUP BY ALL")
def rate_histogram(spark, sf_dir):
    return R.histogram(matched(spark, sf_dir))


@query(f"{_M} SELECT src_id, doc_id, " + ", ".join(f"coalesce(sum(match_words) FILTER ({_LEVEL} = {i}), 0)::BIGINT AS l{i}" for i in range(6)) + ", sum(match_words)::BIGINT AS total_words FROM matches WHERE (src_id, doc_id) IN (SELECT (src_id, doc_id) FROM ranked WHERE round(rate * 100, 2) > 0) GROUP BY ALL")
def report_pivot(spark, sf_dir):
    found = matched(spark, sf_dir)
    return R.pivot(found, M.matched_rank(found, M.totals(M.line_table(bench(spark, sf_dir), "src_id"), PARAMS)))


@query(f"{_M}, bands AS (SELECT unnest(['100%', '>=90%', '<90%']) AS band), m AS (SELECT *, CASE WHEN rate = 1 THEN '100%' WHEN rate >= 0.9 THEN '>=90%' ELSE '<90%' END AS own FROM matches) SELECT src_id, doc_id, band, coalesce(sum(match_words) FILTER (own = band), 0)::BIGINT AS match_words, coalesce(sum(total_words) FILTER (own = band), 0)::BIGINT AS total_words FROM m CROSS JOIN bands GROUP BY ALL")
def match_subtotals(spark, sf_dir):
    return R.subtotals(matched(spark, sf_dir))


@query(f"{_M} SELECT m.src_id, doc_id, src_line + 1 AS src_no, tgt_line + 1 AS tgt_no, round(rate * 100, 2) AS percent, match_words, total_words, coalesce(substr(s.text, 1, 500), '') AS head FROM matches m LEFT JOIN {_SRC} s ON s.src_id = m.src_id AND s.line_no = src_line")
def pair_detail(spark, sf_dir):
    return R.details(matched(spark, sf_dir), L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text"))))


_LIST_SQL = f"{_M}, li AS (SELECT r.src_id, round(r.rate * 100, 2) AS percent, match_count, source || '/' || doc_id AS path, doc_id FROM ranked r JOIN documents USING (doc_id))"
_BY = ("percent DESC", "match_count DESC", "path", "doc_id")


def _listed(name: str, column: int) -> None:
    def f(spark, sf_dir):
        paths = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
        return R.listed(R.result_list(ranked(spark, sf_dir), paths), column)

    f.__name__ = name
    query(f"{_LIST_SQL} SELECT *, row_number() OVER (ORDER BY {_BY[column]}, src_id, doc_id) AS position FROM li")(f)


for _name, _c in (("result_list", 1), ("result_list_by_rate", 0), ("result_list_by_path", 2), ("result_list_by_id", 3)):
    _listed(_name, _c)


@query(f"{_M} SELECT src_id, doc_id, match_count, total, rate, row_number() OVER (ORDER BY rate DESC, src_id, doc_id) AS position FROM ranked")
def ranked_positions(spark, sf_dir):
    """Matched documents, best first."""
    return R.positions(ranked(spark, sf_dir), F.desc("rate"), F.asc("src_id"), F.asc("doc_id"))


@query(f"{_M} SELECT * FROM ranked")
def indexed_search(spark, sf_dir):
    """The search served by a stored index: one language was added first, the others later."""
    docs, index = table(spark, sf_dir, "documents"), LineIndex.create(spark, work_path(spark, "index"), PARAMS)
    index.append(docs.filter("lang = 'en'"))
    index.append(docs)
    return index.search(bench(spark, sf_dir), PARAMS).ranked


_COLOUR = "CASE WHEN {r} = 1 THEN 'LightPink' WHEN {r} >= 0.9 THEN '{mid}' WHEN {r} > 0 THEN 'LightGreen' ELSE 'White' END"


@query(f"{_M} SELECT src_id, doc_id, src_line, {_COLOUR.format(r='rate', mid='Yellow')} AS shown, {_COLOUR.format(r='rate', mid='Cyan')} AS written FROM matches")
def color_class(spark, sf_dir):
    return matched(spark, sf_dir).select("src_id", "doc_id", "src_line", R.colour(F.col("rate")).alias("shown"), R.colour(F.col("rate"), True).alias("written"))


@query(f"{_M} SELECT l.doc_id, l.line_no, coalesce(src_id, -1) AS src_id, coalesce(rate, 0.0) AS rate, {_COLOUR.format(r='coalesce(rate, 0)', mid='Yellow')} AS colour FROM {_DOC} l LEFT JOIN matches m ON m.doc_id = l.doc_id AND m.tgt_line = l.line_no")
def annotated_lines(spark, sf_dir):
    return R.annotated(doc_lines_of(spark, sf_dir), matched(spark, sf_dir)).fillna({"src_id": -1, "rate": 0.0})


@query(f"{_M} SELECT l.src_id, l.line_no, coalesce(doc_id, -1) AS doc_id, coalesce(rate, 0.0) AS rate, {_COLOUR.format(r='coalesce(rate, 0)', mid='Yellow')} AS colour FROM {_SRC} l LEFT JOIN matches m ON m.src_id = l.src_id AND m.src_line = l.line_no")
def annotated_sources(spark, sf_dir):
    return R.annotated(L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text"))), matched(spark, sf_dir), "src").fillna({"doc_id": -1, "rate": 0.0})


@query(f"""{_M}, j AS (SELECT m.*, {N.trim_separator_sql('s.text')} AS a, {N.trim_separator_sql('t.text')} AS b, length(s.text) AS size FROM matches m JOIN {_SRC} s ON s.src_id = m.src_id AND s.line_no = src_line JOIN {_DOC} t ON t.doc_id = m.doc_id AND t.line_no = tgt_line),
c AS (SELECT *, list_filter(string_split(a, ''), lambda z: z <> '') AS ca, list_filter(string_split(b, ''), lambda z: z <> '') AS cb FROM j), k AS (SELECT *, CASE WHEN match_words = total_words THEN 0 ELSE {lcs_sql('ca', 'cb')} END AS g FROM c)
SELECT src_id, src_line, doc_id, tgt_line, (CASE WHEN match_words = total_words THEN size ELSE greatest(2 * g - length(b), 0) END)::INT AS match_chars, (CASE WHEN match_words = total_words THEN size ELSE length(a) END)::INT AS total_chars, CASE WHEN match_words = total_words THEN rate ELSE greatest(2 * g - length(b), 0) / nullif(length(a), 0)::DOUBLE END AS rate FROM k""")
def jp_rescore(spark, sf_dir):
    return R.rescore(matched(spark, sf_dir), L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text"))), doc_lines_of(spark, sf_dir))


@query(f"""WITH l AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 1 THEN '' ELSE text END AS text, {_COLOUR.format(r='(length(text) % 11 / 10.0)', mid='Yellow')} AS colour FROM {_DOC})
SELECT doc_id, line_no, first_value(CASE WHEN text <> '' THEN colour END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS colour FROM l""")
def color_backfill(spark, sf_dir):
    lines = doc_lines_of(spark, sf_dir).withColumn("colour", R.colour(F.length("text") % 11 / 10.0))
    lines = lines.withColumn("text", F.when(F.col("line_no") % 3 == 1, "").otherwise(F.col("text")))
    return R.backfill(lines, "doc_id", "colour").select("doc_id", "line_no", "colour")


# ---- rough filter -------------------------------------------------------------------------

_SIDX = f"(SELECT src_id, line_no, {T.split_words_sql('text')} AS idx FROM {_SRC})"
_SB = f"""sb AS (SELECT src_id, last - n AS first, last, list_transform(range(0, least(len(w), {rough.WORDS})), lambda i: w[(i * len(w) // least(len(w), {rough.WORDS}) + 1)]) AS words FROM
  (SELECT src_id, max(line_no) AS last, count(*)::INT AS n, string_split(string_agg(idx, ' ' ORDER BY line_no) || ' ', ' ') AS w FROM {_SIDX} GROUP BY src_id, line_no // {ROUGH}))"""
_TB = f"""tb AS (SELECT doc_id, k * {rough.STRIDE} AS start, string_agg(text, ' ' ORDER BY line_no) || ' ' AS block FROM
  (SELECT doc_id, line_no, text, unnest(range(greatest(0, ceil((line_no - {rough.STRIDE} - {ROUGH} + 1) / {rough.STRIDE}.0)::INT), line_no // {rough.STRIDE} + 1)) AS k FROM {_DOC}) GROUP BY doc_id, k)"""


@query(f"WITH {_TB} SELECT doc_id, start::INT AS start, length(block)::INT AS size FROM tb")
def rough_blocks(spark, sf_dir):
    return rough.target_blocks(doc_lines_of(spark, sf_dir), ROUGH).select("doc_id", "start", F.length("block").alias("size"))


_ROUGH_SQL = f"""{_SB}, {_TB},
walk(src_id, first, last, doc_id, start, block, words, i, pos, hits, state) AS (
  SELECT src_id, first, last, doc_id, start, block, words, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM sb, tb
  UNION ALL
  SELECT src_id, first, last, doc_id, start, block, words, i + 1, CASE WHEN spot > 0 THEN spot ELSE pos END, hits + (spot > 0)::INT,
    CASE WHEN (i = len(words) - 1 OR i > {rough.WORDS // 2}) AND (hits + (spot > 0)::INT) * 2 < i THEN -1 WHEN length(block) <= CASE WHEN spot > 0 THEN spot ELSE pos END THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN words[i + 1] = '' THEN pos + 1 WHEN strpos(substr(block, pos + 1), words[i + 1]) > 0 THEN pos + strpos(substr(block, pos + 1), words[i + 1]) ELSE 0 END AS spot FROM walk WHERE state = 0 AND i < len(words))),
hit AS (SELECT DISTINCT src_id, first, last, doc_id FROM walk WHERE state = 1 OR state = 0 AND i = len(words)),
mk AS (SELECT DISTINCT src_id, doc_id, unnest(range(first, last + 1))::INT AS line_no FROM hit)"""


@query(f"WITH RECURSIVE {_ROUGH_SQL} SELECT * FROM mk")
def rough_filter(spark, sf_dir):
    src = L.with_index(L.explode(bench(spark, sf_dir), "src_id", L.sentences(F.col("text"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", L.sentences(F.col("text")).alias("lines"))
    return rough.rough_lines(src, docs, ROUGH)


@query(f"""WITH RECURSIVE {_ROUGH_SQL}, {_match_sql(only=" AND (src_id, doc_id, src_line) IN (SELECT (src_id, doc_id, line_no) FROM mk)")},
sh AS (SELECT mk.src_id, doc_id, count(*) AS short FROM sl JOIN mk ON mk.src_id = sl.src_id AND mk.line_no = sl.line_no WHERE len(string_split(idx, ' ')) < {PARAMS.min_words} GROUP BY ALL),
al AS (SELECT src_id, count(*) AS lines FROM sl GROUP BY src_id), mc AS (SELECT src_id, doc_id, count(*)::INT AS match_count FROM matches GROUP BY ALL)
SELECT src_id, doc_id, match_count, (lines - coalesce(short, 0))::INT AS total, match_count / (lines - coalesce(short, 0))::DOUBLE AS rate FROM mc JOIN al USING (src_id) LEFT JOIN sh USING (src_id, doc_id)""")
def rough_search(spark, sf_dir):
    """The whole search behind the rough filter, with its own denominators."""
    from dataclasses import replace

    return M.search(bench(spark, sf_dir), table(spark, sf_dir, "documents"), replace(PARAMS, rough_lines=ROUGH))[1]


# ---- locating -----------------------------------------------------------------------------


_BODY = "regexp_replace(l.text, '^[0-9]+\\.?[\\t-\\r\\x85\\p{Z}]+', '')"


@query(f"""{_M} SELECT m.src_id, m.doc_id, m.src_line, strpos(d.text, {_BODY}) > 0 AS found, (strpos(d.text, trim({_BODY})) - 1)::INT AS "begin", (strpos(d.text, trim({_BODY})) + length(trim({_BODY})) - 2)::INT AS "end"
FROM matches m JOIN {_DOC} l ON l.doc_id = m.doc_id AND l.line_no = m.tgt_line JOIN documents d ON d.doc_id = m.doc_id
WHERE NOT (length(l.text) < {P.LEAST_CHARS} AND len(string_split({_BODY}, ' ')) < {P.LEAST_WORDS})""")
def pattern_spans(spark, sf_dir):
    """Matched target lines looked up in their documents: each must be found again, at its first place."""
    lines = doc_lines_of(spark, sf_dir).select("doc_id", F.col("line_no").alias("tgt_line"), F.col("text").alias("line"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = R.few(matched(spark, sf_dir))
    hit = lines.join(hit, ["doc_id", "tgt_line"]).withColumn("search", P.prepared(F.col("line"))).filter("search is not null")
    hit = P.spans_in(hit, texts, ["src_id", "src_line"])
    first = F.get("spans", F.lit(0))
    return hit.select("src_id", "doc_id", "src_line", (F.size("spans") > 0).alias("found"), first["begin"].alias("begin"), first["end"].alias("end"))


_OFF = f"(SELECT doc_id, line_no, text, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(text) - 1)::INT AS start, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 2)::INT AS \"end\" FROM {_DOC})"
_SPANS = "(SELECT doc_id, n::INT AS span_no, (n * 97)::INT AS \"begin\", (n * 97 + 150)::INT AS stop FROM (SELECT doc_id, unnest(range((length(text) + 96) // 97)) AS n FROM documents))"


def _spans(spark, sf_dir) -> DataFrame:
    """Spans of 151 characters over the whole of every document, one at every 97th character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).filter("n > 0")
    docs = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 97).cast("int"))).alias("span_no"))
    return docs.select("doc_id", "span_no", (F.col("span_no") * 97).alias("begin"), (F.col("span_no") * 97 + 150).alias("end"))


@query(f'SELECT doc_id, line_no, start, "end" FROM {_OFF}')
def para_offsets(spark, sf_dir):
    return P.paragraph_offsets(doc_lines_of(spark, sf_dir), "doc_id").select("doc_id", "line_no", "start", "end")


@query(f'SELECT s.doc_id, span_no, "begin", arg_max(line_no, (start, line_no)) AS line_no FROM {_SPANS} s JOIN {_OFF} p ON p.doc_id = s.doc_id AND start <= "begin" GROUP BY ALL')
def span_paragraph_asof(spark, sf_dir):
    return P.paragraph_at(_spans(spark, sf_dir), P.paragraph_offsets(doc_lines_of(spark, sf_dir), "doc_id"), "doc_id").filter("line_no is not null")


_OVER = f'(SELECT s.doc_id, span_no, line_no, (greatest("begin", start) - start)::INT AS "from", (least(stop, "end") - start)::INT AS "to" FROM {_SPANS} s JOIN {_OFF} p ON p.doc_id = s.doc_id AND "begin" <= "end" AND stop >= start AND "end" >= start)'


@query(f"SELECT * FROM {_OVER}")
def span_paragraph_overlap(spark, sf_dir):
    return P.overlapping(_spans(spark, sf_dir), P.paragraph_offsets(doc_lines_of(spark, sf_dir), "doc_id"), "doc_id")


@query(f"""WITH r AS (SELECT doc_id, line_no, unnest(range((length(text) + 19) // 20))::INT AS run_no, text FROM {_DOC})
SELECT o.doc_id, span_no, o.line_no, run_no, greatest("from" - run_no * 20, 0)::INT AS run_from, least("to" - run_no * 20, least(20, length(text) - run_no * 20) - 1)::INT AS run_to
FROM {_OVER} o JOIN r ON r.doc_id = o.doc_id AND r.line_no = o.line_no AND "from" < run_no * 20 + least(20, length(text) - run_no * 20) AND "to" >= run_no * 20""")
def span_runs(spark, sf_dir):
    """Parts of spans in runs of twenty characters."""
    lines = doc_lines_of(spark, sf_dir)
    parts = P.overlapping(_spans(spark, sf_dir), P.paragraph_offsets(lines, "doc_id"), "doc_id")
    n = F.length("text")
    runs = lines.filter(n > 0).select("doc_id", "line_no", n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / 20).cast("int"))).alias("run_no"))
    runs = runs.select("doc_id", "line_no", "run_no", (F.col("run_no") * 20).alias("tx_start"), F.least(F.lit(20), F.col("n") - F.col("run_no") * 20).alias("tx_len"), F.lit(0).alias("orig_start"))
    return P.runs_of(parts, runs, "doc_id")


_HEAD_SQL = f"substr(trim({{}}, {N.quote(L.SPACE)}), 1, {P.HEAD})"
_BARE_LINE = f"trim(trim({{}}, {N.quote(L.SPACE)}), '.')"
_STEP_P = "list_filter(range(a.least, len(r)), lambda k: contains(r[k + 1], h.head) AND h.head <> '')[1]"
_STEP_L = "list_filter(range(a.line, len(b)), lambda k: h.bare <> '' AND strpos(substr(b[k + 1], CASE WHEN k = a.line THEN a.at + 1 ELSE 1 END), h.bare) > 0)[1]"


@query(f"""WITH d AS (SELECT doc_id, {L.sentences_sql('text')} AS s, {L.rows_sql('text')} AS r FROM documents),
e AS (SELECT doc_id, r, list_transform(r, lambda x: {_BARE_LINE.format('x')}) AS b, list_transform(s, lambda x: {{'piece': x, 'head': {_HEAD_SQL.format('x')}, 'bare': substr({_BARE_LINE.format('x')}, 1, {P.HEAD})}}) AS hs FROM d),
p AS (SELECT doc_id, list_reduce(hs, lambda a, h: CASE WHEN {_STEP_P} IS NULL THEN {{'least': a.least, 'place': a.place, 'out': list_append(a.out, a.place)}}
  ELSE {{'least': CASE WHEN suffix(rtrim(h.piece, {N.quote(L.SPACE)}), '.') THEN {_STEP_P} + 1 ELSE a.least END, 'place': {_STEP_P}, 'out': list_append(a.out, {_STEP_P})}} END, {{'least': 0::BIGINT, 'place': -1::BIGINT, 'out': CAST([] AS BIGINT[])}}).out AS paragraphs FROM e),
q AS (SELECT doc_id, list_reduce(hs, lambda a, h: CASE WHEN {_STEP_L} IS NULL THEN {{'line': a.line, 'at': a.at, 'out': list_append(a.out, -1)}}
  ELSE list_transform([{_STEP_L}], lambda k: list_transform([strpos(substr(b[k + 1], CASE WHEN k = a.line THEN a.at + 1 ELSE 1 END), h.bare) - 1 + CASE WHEN k = a.line THEN a.at ELSE 0 END + length(h.piece)], lambda z:
    {{'line': CASE WHEN z >= length(b[k + 1]) THEN k + 1 ELSE k END, 'at': CASE WHEN z >= length(b[k + 1]) THEN 0 ELSE z END, 'out': list_append(a.out, k)}})[1])[1] END, {{'line': 0::BIGINT, 'at': 0::BIGINT, 'out': CAST([] AS BIGINT[])}}).out AS lines FROM e)
SELECT doc_id, array_to_string(paragraphs, ',') AS paragraphs, array_to_string(lines, ',') AS lines FROM p JOIN q USING (doc_id)""")
def forward_places(spark, sf_dir):
    """Sentences of every document found again in its lines, in order: by paragraph and by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", L.sentences(F.col("text")).alias("s"), L.rows(F.col("text")).alias("r"))
    listed = lambda c: F.array_join(c.cast("array<string>"), ",")
    return docs.select("doc_id", listed(P.forward_paragraphs_arrow("s", "r")).alias("paragraphs"), listed(P.forward_lines_arrow("s", "r")).alias("lines"))


@query("SELECT max(n) AS longest FROM (" + ORACLES["numeric_runs"].replace("SELECT conv_id, min(line_no) AS first_line, count(*) AS n_lines, sum(len(string_split(t, ' ')))::BIGINT AS n_pieces", "SELECT sum(len(string_split(t, ' ')))::BIGINT AS n") + ")")
def longest_numeric_run(spark, sf_dir):
    return numeric_runs(spark, sf_dir).agg(F.max("n_pieces").alias("longest"))


# ---- control ------------------------------------------------------------------------------


@query("SELECT DISTINCT source AS src, lang AS target FROM documents")
def queue_dedup(spark, sf_dir):
    return C.queue(table(spark, sf_dir, "documents").select(F.col("source").alias("src"), F.col("lang").alias("target")))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def existing_antijoin(spark, sf_dir):
    return C.new_only(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_chars")
