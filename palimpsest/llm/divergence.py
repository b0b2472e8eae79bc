"""Source divergence audit: how far the term shares of sources stand apart, by inclusion and exclusion over supports.

The distance of two sources is a sum over all terms of their language, but most terms are missing in
most sources. With f(0, 0) for a term that both lack, and a term of only one source priced with the
other's share of a missing term, the sum falls apart into

* one-sided sums: a source's histogram (count -> number of terms with it), priced once against each
  other source's share of a missing term,
* corrections f(p, q) - f(p, 0) - f(0, q) + f(0, 0) of terms that both hold: a join of postings,
* the constant f(0, 0), as often as the language has terms less those of either side.

Nothing is summed over the terms that a source lacks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, small

#: Documents that must hold a term for it to be kept in their language, and terms of a group in the report.
LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: A task hands on what it has counted after so many terms or bytes of text.
HELD_TERMS, HELD_BYTES = 200_000, 32 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters and of everything beyond ASCII, A-Z lower-cased; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in each group, and documents that hold it.

    A task counts what it reads before anything is shuffled, in tables of bounded size. A null language or
    source is the empty one; a repeated row counts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        terms = seen = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, t, n, d[t]) for (lang, source), (c, d) in held.items() for t, n in c.items()]
            held.clear()
            langs, sources, names, n, d = zip(*rows) if rows else ((),) * 5
            columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
                words = terms_of(text)
                terms -= len(occurrences)
                occurrences.update(words)
                documents.update(set(words))
                terms += len(occurrences)
                seen += len(text or "")
                if terms > HELD_TERMS or seen > HELD_BYTES:
                    yield flush()
                    terms = seen = 0
        yield flush()

    rows = docs.select(_named("lang"), _named("source"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def _share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term with n occurrences in a group of ``total``, in exact integers."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", scaled, (total + 2 * kept).cast("decimal(19,0)"))


def _apart(p: Column, q: Column) -> Column:
    """f: both shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has a source's distance to each other source
    of its language, part ``term`` the terms that it holds more often than its language, best first.

    A group without terms has its pairs as well; a language without kept terms has pairs of value 0; an
    empty table has no rows. Documents without terms still make their group occur. Equal values are
    ordered by item, in the order of its UTF-8 bytes. Other columns of ``docs`` are not looked at."""
    counts = materialise(counted(docs, text_col), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)
    terms = materialise(terms.drop("docs"), "terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    bare = materialise(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "bare")
    own = bare.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    occurring = docs.select(_named("lang"), _named("source")).distinct()
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("total", "held", "v", "total_lang")))
    none = F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).alias("none")
    groups = materialise(groups.select("*", none), "groups")
    known = small(groups)
    shares = bare.join(known, ["lang", "source"]).select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    shares = materialise(shares, "shares")
    return _pairs(shares, groups).unionByName(_terms(shares))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    a, b, known = groups.alias("a"), groups.alias("b"), small(groups)
    both = a.join(small(groups).alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    rest = F.when(F.col("a.v") > 0, (F.col("a.v") - F.col("a.held") - F.col("b.held")) * _apart(F.col("a.none"), F.col("b.none"))).otherwise(0)
    constant = both.select("a.lang", "a.source", F.col("b.source").alias("item"), rest.cast("bigint").alias("value"))
    # One-sided: each histogram row meets the other groups' shares of a missing term.
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    other = known.select("lang", F.col("source").alias("item"), F.col("none"))
    priced = histogram.join(other, "lang").filter("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * _apart(F.col("p"), F.col("none"))).alias("value"))
    # Both-sided: postings of a term meet, each unordered pair once.
    left = shares.select("lang", "term", "source", "p")
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    shared = left.join(right, ["lang", "term"]).filter("source < item")
    missing = lambda c, n: known.select("lang", F.col("source").alias(c), F.col("none").alias(n))
    shared = shared.join(missing("source", "p0"), ["lang", "source"]).join(missing("item", "q0"), ["lang", "item"])
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    correction = _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)
    corrected = shared.groupBy("lang", "source", "item").agg(F.sum(correction).alias("value"))
    one = priced.unionByName(corrected)
    mirrored = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    total = constant.unionByName(one).unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(shares: DataFrame) -> DataFrame:
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return above.withColumn("rank", rank).filter(F.col("rank") <= TOP)


def op11_sql() -> str:
    """Every term of a language against every pair of its sources, without any shortcut."""
    f = "((p - q) * (p - q)) // (p + q)"
    p = f"(1 + ({SCALE}::HUGEINT * (n + 2)) // (total + 2 * v))"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, v FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    s AS (SELECT lang, source, term, n, v, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS total_lang FROM full_),
    share AS (SELECT lang, source, term, n, {p} AS p, (1 + ({SCALE}::HUGEINT * (n_lang + 2)) // (total_lang + 2 * v)) AS q FROM s),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(x.value), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT l.lang, l.source, r.source AS item, ((l.p - r.p) * (l.p - r.p)) // (l.p + r.p) AS value FROM share l JOIN share r USING (lang, term)) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY ALL),
    both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, {f} FROM share WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
