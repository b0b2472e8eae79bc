"""Files: scan, Word documents, CSV, result log, settings, stream."""

import zipfile

from pyspark.sql import functions as F

from palimpsest.operators import lines
from palimpsest.operators.matching import SearchParams
from palimpsest.sources import corpus, docx, settings
from palimpsest.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MATH = "http://schemas.openxmlformats.org/officeDocument/2006/math"
BODY = f"""<w:document xmlns:w="{W}" xmlns:m="{MATH}"><w:body>
<w:p><w:r><w:t>Hello “world”</w:t></w:r><w:r><w:rPr><w:rFonts w:ascii="Symbol"/></w:rPr><w:t>a</w:t></w:r><w:r><w:sym w:char="F062"/></w:r></w:p>
<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><m:oMath><m:r><m:t>x</m:t></m:r><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:oMath></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:t>PAGE</w:t></w:r><w:r><w:fldChar w:fldCharType="separate"/><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
</w:body></w:document>"""


def make_docx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", BODY)


def test_scan_filter(spark):
    paths = ["a/x.DOCX", "a/x.txt", "a/.index/x.txt", "a/.x.txt", ".a/x.txt", "a/x.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.filter(corpus.wanted(F.col("path"))).collect()] == ["a/x.DOCX", "a/x.txt"]


def test_docx(spark, tmp_path):
    make_docx(tmp_path / "a.docx")
    (tmp_path / "broken.docx").write_bytes(b"nothing")
    rows = docx.read(corpus.scan(spark, str(tmp_path))).collect()
    good = sorted((r for r in rows if r["error"] is None), key=lambda r: r["para_no"])
    assert [r["text"] for r in good] == ['Hello "world"αβ', "gonex^(2)", "7"]
    assert sum(r["error"] is not None for r in rows) == 1
    assert docx.texts(corpus.scan(spark, str(tmp_path))).count() == 1
    marked = docx.highlighted((tmp_path / "a.docx").read_bytes(), {0: "LightPink"})
    (tmp_path / "b.docx").write_bytes(marked)
    assert docx.paragraphs(marked)[0][0] == 'Hello "world"αβ'
    with zipfile.ZipFile(tmp_path / "b.docx") as z:
        assert b"FFB6C1" in z.read("word/document.xml")


def test_csv_and_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', 0.5)], "src_id int, path string, rate double")
    corpus.write_csv(df, str(tmp_path / "csv"))
    assert corpus.read_csv(spark, str(tmp_path / "csv"), "src_id int, path string, rate double").collect() == df.collect()
    corpus.write_results(df, df, df, str(tmp_path / "log"))
    corpus.write_results(df.limit(0), df, df, str(tmp_path / "log"), "other")
    assert [t.count() for t in corpus.read_results(spark, str(tmp_path / "log"))] == [1, 1, 1]
    assert [t.count() for t in corpus.read_results(spark, str(tmp_path / "log"), "other")] == [0, 1, 1]


def test_texts_pages_and_queue(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.txt").write_text("a\nb")
    assert corpus.read_texts(spark, str(tmp_path / "t")).select("text").first()[0] == "a\nb"
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id int, page_no int, text string")
    assert corpus.read_pages(pages).first()["text"] == "a\nb"
    pages = spark.createDataFrame([(1, 1, "Head.\n1 2\n3 4"), (1, 2, "Tail line.\nMore text.")], "doc_id int, page_no int, text string")
    alone = lines.segment_full(pages.select("page_no", "text"), "page_no").orderBy("page_no").collect()
    by_page = "\n".join(r["text"] for r in alone)
    assert corpus.read_pages(pages, segment=True).first()["text"] == by_page
    asked = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "src string, target string")
    assert corpus.queue(asked).count() == 2


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert settings.load(path) == SearchParams()
    settings.save(SearchParams(rate=0.8, is_jp=True), path)
    assert settings.load(path) == SearchParams(rate=0.8, is_jp=True)


def test_stream(spark, tmp_path):
    line = "one two three four five six seven"
    sources = spark.createDataFrame([(1, line)], "src_id bigint, text string")
    spark.createDataFrame([(5, line), (6, "other words here")], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    params = SearchParams(min_words=2)
    q = ingest.watch(spark, str(tmp_path / "in"), sources, str(tmp_path / "out"), str(tmp_path / "ck"), params)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/doc_matches")).collect()
    assert [(r["doc_id"], r["rate"]) for r in got] == [(5, 1.0)]


def test_highlighted_parts_split_runs(spark, tmp_path):
    mc = "http://schemas.openxmlformats.org/markup-compatibility/2006"
    body = f"""<w:document xmlns:w="{W}" xmlns:m="{MATH}" xmlns:mc="{mc}" xmlns:w14="urn:w14" xmlns:ns1="urn:other" mc:Ignorable="w14 ns1"><w:body>
<w:p><w:r><w:rPr><w:b/><w:shd w:fill="000000"/><w:lang w:val="en"/></w:rPr><w:t>one two</w:t><w:tab/><w:t>three</w:t></w:r><w:r><w:t xml:space="preserve"> four &lt;5&gt;</w:t></w:r></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>SEQ x</w:instrText></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:t>in</w:t></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>ner</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:fldSimple w:instr="PAGE"><w:r><w:t>8</w:t></w:r></w:fldSimple></w:p>
</w:body></w:document>"""
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    content = (tmp_path / "a.docx").read_bytes()
    assert [t for t, _ in docx.paragraphs(content)] == ["one two three four <5>", "78"]
    part = (0, 4, 16, "Yellow")
    made = docx.highlighted(content, {1: "Cyan"}, [part])
    assert [t for t, _ in docx.paragraphs(made)] == ["one two three four <5>", "78"]
    assert docx.shaded(made) == [[None] * 4 + ["FFFF00"] * 13 + [None] * 5, ["00FFFF"] * 2]
    assert docx.agrees(content, made, part) and not docx.agrees(content, made, (0, 0, 6, "Yellow"))
    (tmp_path / "b.zip").write_bytes(made)
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        xml = z.read("word/document.xml").decode()
    assert all(f"xmlns:{p}=" in xml for p in ("w", "m", "mc", "w14", "ns1")) and 'mc:Ignorable="w14 ns1"' in xml
    assert "fldChar" not in xml and "SEQ" not in xml and "fldSimple" not in xml and "000000" not in xml
    files = corpus.scan(spark, str(tmp_path)).filter("path like '%.docx'")
    runs = docx.run_table(docx.read(files)).filter("line_no = 0").orderBy("run_no").collect()
    assert [(r["tx_start"], r["tx_len"]) for r in runs] == [(0, 7), (7, 1), (8, 5), (13, 9)]
    path = files.first()["path"]
    parts = spark.createDataFrame([(path, *part)], "path string, line_no int, `from` int, `to` int, colour string")
    row = docx.copies(files, parts).first()
    assert (row["n_parts"], row["n_agree"], row["error"]) == (1, 1, None) and bytes(row["content"]) == docx.highlighted(content, {}, [part])


def test_from_a_search_to_verified_copies(spark, tmp_path):
    from palimpsest.operators.highlight import highlighted

    para = lambda *runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"
    line, other = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    bodies = {"a": para("Intro here.") + para("") + para(line[:14], line[14:]) + para(other), "b": para("nothing of it at all here"), "c": para(other.replace("seven", "eight"))}
    for name, body in bodies.items():
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    files = corpus.scan(spark, str(tmp_path))
    src = spark.createDataFrame([(1, line), (2, other)], "src_id int, text string")
    made = highlighted(src, files, SearchParams(rate=0.6, min_words=3))
    got = {r["path"].rsplit("/", 1)[1]: r for r in made.copies.collect()}
    assert {k: (r["n_parts"], r["n_agree"], r["error"]) for k, r in got.items()} == {"a.docx": (2, 2, None), "c.docx": (1, 1, None)}
    fills = docx.shaded(bytes(got["a.docx"]["content"]))
    assert fills[0] == [None] * 11 and len(set(fills[2])) == 1 and fills[2][0] and len(fills[2]) == len(line) and all(fills[3])
    assert docx.shaded(bytes(got["c.docx"]["content"]))[0][0] != fills[3][0]
    assert {(r["src_id"], r["status"]) for r in made.located.collect()} == {(1, "found"), (2, "found")}
    made.found.release()


def test_sidecar_texts(spark, tmp_path):
    for name, text in (("d/.index/a.txt", "one\ntwo"), ("d/.index/a.idx", "no"), ("d/b.txt", "no"), ("d/e/f/.index/c.txt", "deep"), (".index/top.txt", "top")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = corpus.sidecar_texts(spark, str(tmp_path)).collect()
    assert {r["path"].split(str(tmp_path))[1]: r["text"] for r in got} == {"/d/.index/a.txt": "one\ntwo", "/d/e/f/.index/c.txt": "deep", "/.index/top.txt": "top"}
    assert corpus.sidecar_texts(spark, str(tmp_path / "d/e/f/.index")).count() == 0
