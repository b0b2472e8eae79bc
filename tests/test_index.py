"""The stored index: the same results as a search over the texts, in batches, in other sessions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import matching as M
from palimpsest.sources import index as I
from palimpsest.sources.index import LineIndex


def texts(n, seed):
    random.seed(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    return ["\n".join(" ".join(random.choices(words, k=random.randrange(2, 9))) for _ in range(5)) for _ in range(n)]


def rows(found):
    matches = sorted(tuple(r) for r in found.matches.select("src_id", "src_line", "doc_id", "tgt_line", "rate").collect())
    return matches, sorted(tuple(r) for r in found.ranked.select("src_id", "doc_id", "match_count", "total", "rate").collect())


def test_search_by_index(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([*enumerate(texts(30, 1)), (100, None), (101, "")], "doc_id bigint, text string")
    src = spark.createDataFrame([*enumerate(texts(6, 2))], "src_id bigint, text string")
    params = M.SearchParams(rate=0.7, min_words=3)
    index = LineIndex.create(spark, f"file://{tmp_path}/index", params, buckets=4)
    assert index.append(docs.filter("doc_id % 2 = 0")) and index.append(docs) and index.append(docs) is None
    want = rows(M.search(src, docs, params))
    assert rows(index.search(src, params)) == want and want[0]
    # Rows of a batch that was not finished are not seen.
    lost = spark.createDataFrame([("alpha", 999, 0, 1, 1, "lost")], "w string, doc_id bigint, tgt_line int, m int, c bigint, batch string")
    index._write("postings", lost)
    other = LineIndex(spark.newSession(), f"file://{tmp_path}/index")
    assert other.table("documents").count() == 32 and other.table("postings").filter("doc_id = 999").count() == 0
    # Sources too large to send around: only they are shuffled, the postings are read by bucket.
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    found = index.search(src, params)
    assert rows(found) == want
    where = index.table("postings")
    keys = spark.createDataFrame([("alpha", 1, 0, 3, 0.7, 0)], "w string, src_id bigint, src_line int, n int, t double, k bigint").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.candidate_ids(keys, where, params)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("hashpartitioning(w#") == 1


def test_index_knows_its_lines(spark, tmp_path):
    index = LineIndex.create(spark, f"file://{tmp_path}/index", M.SearchParams(segmenter="full"), buckets=2)
    text = "Alpha beta gamma delta\n1 2 3 4\n5 6 7 8\nEta zeta eps"
    index.append(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    src = spark.createDataFrame([(5, text)], "src_id int, text string")
    with pytest.raises(ValueError):
        index.search(src, M.SearchParams())
    with pytest.raises(ValueError):
        index.search(src, M.SearchParams(segmenter="full", rough_lines=5))
    for exclude in (False, True):
        params = M.SearchParams(min_words=2, segmenter="full", exclude_tables=exclude)
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        assert rows(index.search(src, params)) == rows(M.search(src, docs, params))
    assert index.search(src.filter(F.lit(False)), M.SearchParams(segmenter="full")).ranked.count() == 0


def test_postings_are_lists(spark, tmp_path):
    """A frequent word is a few rows, not one for each line, and loses none; ids may hold any sign."""
    docs = spark.createDataFrame([(f"a:{i} \x1e é", "alpha alpha beta\nalpha word" + str(i) + "\n- -  alpha") for i in range(50)], "doc_id string, text string")
    index = LineIndex.create(spark, f"file://{tmp_path}/index", kind="string", buckets=2)
    index.append(docs.repartition(1))
    got = {tuple(r) for r in index.table("postings").select("w", "doc_id", "tgt_line", "m", "c").collect()}
    want = M.postings(M.line_table(docs, "doc_id")).select("w", "doc_id", "tgt_line", "m", "c").collect()
    assert got == {tuple(r) for r in want} and len(want) == len(got) == 300
    assert index._stored("postings").filter("w = 'alpha'").count() == 2


def test_lists_are_bounded(monkeypatch):
    monkeypatch.setattr(I, "LIST_LINES", 3)
    monkeypatch.setattr(I, "HANDED_LINES", 5)
    lines = ["x", " x  y ", "y x x", "x", "x x", "", "x y", "x"]
    batches = list(I._listed(pa.array(range(8), pa.int32()), pa.array(list("abcdefgh")), pa.array(lines)))
    got = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert got == [("x", 1, 3, "0:1:a 1:2:b 3:1:d"), ("x", 1, 2, "6:2:g 7:1:h"), ("x", 2, 2, "2:3:c 4:2:e"), ("y", 1, 3, "1:2:b 2:3:c 6:2:g")]
    assert len(batches) > 1 and not list(I._listed(pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], pa.string())))


def test_shared_pieces_lose_no_pair(spark, tmp_path):
    """Lines that share one rare piece only are no candidates; all that reach the rate are."""
    docs = spark.createDataFrame([*enumerate(texts(40, 5))], "doc_id bigint, text string")
    src = spark.createDataFrame([*enumerate(texts(8, 6))], "src_id bigint, text string")
    index = LineIndex.create(spark, f"file://{tmp_path}/index", buckets=2)
    index.append(docs)
    for params in (M.SearchParams(rate=0.3, min_words=1), M.SearchParams(rate=0.7, min_words=2, separators=True)):
        assert rows(index.search(src, params)) == rows(M.search(src, docs, params))
    lines, params = M.line_table(src, "src_id"), M.SearchParams(rate=0.6, min_words=1)
    where = index.table("postings")
    seen = where.groupBy("w").agg(F.count("*").alias("df"))
    one, two = (M.candidate_ids(M.prefixes(lines, seen, params, n), where, params).count() for n in (1, 2))
    assert two < one


def test_known_documents_without_shuffle(spark, tmp_path, monkeypatch):
    """Documents are added alike whether the known ones are sent around or not."""
    docs = spark.createDataFrame([*enumerate(texts(12, 7))], "doc_id bigint, text string")
    for most in (0, 100):
        monkeypatch.setattr(I, "KNOWN_ROWS", most)
        index = LineIndex.create(spark, f"file://{tmp_path}/index{most}", buckets=2)
        assert index.append(docs.filter("doc_id < 5")) and index.append(docs) and index.append(docs) is None
        assert sorted(r[0] for r in index.table("documents").collect()) == list(range(12))
        assert index.table("lines").count() == M.line_table(docs, "doc_id").count()
