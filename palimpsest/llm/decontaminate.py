"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are short and documents long, so the Jaccard similarity of a leaked item and its
document tends to nothing and a sketch of the document would miss it. The sketch is taken of
the item instead. Items are partitioned by size; in a partition whose largest item has n
shingles, each item keeps its k = n - ceil(t * n) + 1 minimal hashes (a bottom-k MinHash). A
document that holds the share t of an item's shingles lacks at most k - 1 of them, so it holds
one of the k: the search loses nothing. Candidates are then verified on the shingles themselves.

Only DataFrame functions run here: shingles come from zipped array slices and a generator, so
hashing, probing and counting stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialise, small

SHINGLE = 5
PERCENT = 80
#: Rows of three longs of the items' sketches that are broadcast at most (48 MB).
SKETCH_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingled(df: DataFrame, keep: list[str], words_col: str, short: tuple[int, ...] | None = None) -> DataFrame:
    """A row ``(keep..., g)`` for each five-word shingle, repeats included; ``g`` is a struct of words. Fewer words
    make one shingle of all of them, none make none; with ``short``, every run of that many words is one instead."""
    w, n = F.col(words_col), F.size(words_col)
    zipped = F.arrays_zip(*[(w if i == 0 else F.slice(w, i + 1, F.greatest(n, F.lit(1)))).alias(f"w{i}") for i in range(SHINGLE)])
    out = df.filter(n > 0).select(*keep, n.alias("__n"), F.posexplode(zipped).alias("__at", "g"))
    whole = F.col(f"g.w{SHINGLE - 1}").isNotNull()
    if short is None:
        return out.filter(whole | ((F.col("__n") < SHINGLE) & (F.col("__at") == 0))).select(*keep, "g")
    if not short:
        return out.filter(whole).select(*keep, "g")
    word = lambda i, width: F.when(F.lit(i < width), F.col(f"g.w{i}")).alias(f"w{i}")
    cut = [F.when(F.col(f"g.w{width - 1}").isNotNull(), F.struct(*(word(i, width) for i in range(SHINGLE)))) for width in (*short, SHINGLE)]
    return out.select(*keep, F.explode(F.array_compact(F.array(*cut))).alias("g"))


def widths(items: DataFrame) -> tuple[int, ...]:
    """Lengths of the items of fewer words than a shingle: four numbers at most."""
    n = F.size(words(F.col("text"))).alias("n")
    return tuple(sorted(r["n"] for r in items.select(n).filter((F.col("n") > 0) & (F.col("n") < SHINGLE)).distinct().collect()))


def _hash() -> Column:
    return F.xxhash64(*[F.col(f"g.w{i}") for i in range(SHINGLE)])


def _spelled() -> Column:
    return F.concat_ws(" ", *[F.col(f"g.w{i}") for i in range(SHINGLE)])


def sketches(items: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``items(item_id, text)`` -> (all distinct shingles ``(item_id, n, need, s)``, sketch ``(h, item_id, need)``).

    Size partitions are the powers of two of the shingle count."""
    split = items.select("item_id", words(F.col("text")).alias("w"))
    grams = shingled(split, ["item_id"], "w").select("item_id", _hash().alias("h"), _spelled().alias("s")).distinct()
    sized = grams.groupBy("item_id").agg(F.count("*").alias("n"))
    top = F.expr("shiftleft(1L, length(bin(n)))") - 1
    ceil = lambda n: F.floor((n * percent + 99) / 100).cast("bigint")
    sized = sized.select("item_id", "n", ceil(F.col("n")).alias("need"), (top - ceil(top) + 1).alias("k"))
    all_grams = materialise(grams.join(sized, "item_id"), "items")
    least = all_grams.groupBy("item_id", "need", "k").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    sketch = least.select(F.explode(F.slice("hs", 1, F.col("k").cast("int"))).alias("h"), "item_id", "need")
    return all_grams.select("item_id", "n", "need", "s"), materialise(sketch, "sketch")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` for each document and item of which the
    document holds at least ``percent`` of the distinct five-word shingles.

    Words are runs of letters and digits, lower-cased. Null or wordless texts on either side match
    nothing; an item under five words is one shingle, found wherever its words follow one another.
    Rows that share an id count as one document (or item); null ids match nothing; further columns
    are ignored; empty tables give an empty table.
    """
    items = items.select("item_id", "text").filter("item_id is not null")
    grams, sketch = sketches(items, percent)
    short = widths(items)
    split = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).filter("doc_id is not null")
    sized = split.withColumn("size", F.greatest(F.lit(1), F.size("w") - SHINGLE + 1))
    probes = shingled(sized, ["doc_id"], "w", short).select("doc_id", _hash().alias("h"))
    hits = probes.join(small(sketch, SKETCH_ROWS), "h").select("doc_id", "item_id").distinct()
    candidates = materialise(hits, "candidates")
    ids = materialise(candidates.select("doc_id").distinct(), "candidate-ids")
    texts = split.join(small(ids), "doc_id", "left_semi")
    exact = shingled(texts, ["doc_id"], "w", short).select("doc_id", _spelled().alias("s"))
    shared = exact.join(small(grams), "s").join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = shared.groupBy("doc_id", "item_id", "n", "need").agg(F.count_distinct("s").alias("n_shared"))
    return counted.filter("n_shared >= need").select("doc_id", "item_id", F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns are kept, and rows without an id too. Rows that share
    an id go or stay together, repeated rows likewise; null and empty texts stay, an empty table stays empty."""
    name = free(docs, "__bad")
    bad = materialise(contained(docs, items, id_col, text_col, percent).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(small(bad), F.col(id_col) == F.col(name), "left_anti")


def op7_sql(percent: int = PERCENT) -> str:
    """DuckDB: every document against every item, without a sketch."""
    gram = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    split = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH i AS (SELECT item_id, unnest({gram}) AS s FROM (SELECT item_id, {split} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
t AS (SELECT doc_id, {split} AS w FROM documents),
k AS (SELECT DISTINCT len(w) AS k FROM (SELECT {split} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4 UNION SELECT 5),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM t JOIN k ON len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared / n::DOUBLE AS containment
FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= {percent} * n"""
