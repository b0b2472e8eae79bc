"""Segmenter, search, assignment, reports and location on small literal tables."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from palimpsest.operators import lines as L
from palimpsest.operators import locate as P
from palimpsest.operators import matching as M
from palimpsest.operators import report as R
from palimpsest.operators import rough


def naive_greedy(pairs):
    used, taken, done = set(), [], set()
    for s, t in sorted(pairs):
        if s not in done and t not in used:
            done.add(s)
            used.add(t)
            taken.append((s, t))
    return taken


def test_greedy_is_first_fit(spark):
    random.seed(5)
    rows, want = [], {}
    for g in range(30):
        pairs = {(random.randrange(6), random.randrange(8)) for _ in range(random.randrange(1, 20))}
        want[g] = naive_greedy(pairs)
        rows += [(1, s, g, t, 1, 1, 1.0) for s, t in pairs]
    df = spark.createDataFrame(rows, "src_id int, src_line int, doc_id int, tgt_line int, match_words int, total_words int, rate double")
    got = {}
    for r in M.greedy(df).collect():
        got.setdefault(r["doc_id"], []).append((r["src_line"], r["tgt_line"]))
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v) for g, v in want.items()}


def naive_pairs(src, tgt, rate):
    from test_functions import table_lcs

    out = set()
    for s, a in enumerate(src):
        for t, b in enumerate(tgt):
            x, y = a.split(), b.split()
            if x and y and table_lcs(x, y) / max(len(x), len(y)) >= rate:
                out.add((s, t))
    return out


def test_pruned_join_loses_nothing(spark):
    random.seed(9)
    make = lambda: " ".join(random.choice("abcdefg") * random.choice((1, 2)) for _ in range(random.randrange(1, 12)))
    src, tgt = [make() for _ in range(40)], [make() for _ in range(60)]
    tgt[:10] = [" ".join(s.split()[:-1] + ["z"]) for s in src[:10]]
    a = spark.createDataFrame([(1, "\n".join(src))], "src_id int, text string")
    b = spark.createDataFrame([(2, "\n".join(tgt))], "doc_id int, text string")
    for rate in (0.3, 0.6, 1.0):
        params = M.SearchParams(rate=rate, min_words=1)
        for native in (False, True):
            found = M.similarity_join(M.line_table(a, "src_id"), M.line_table(b, "doc_id"), params, native)
            assert {(r["src_line"], r["tgt_line"]) for r in found.collect()} == naive_pairs(src, tgt, rate)


def test_separators_are_lossless_too(spark):
    a = spark.createDataFrame([(1, "a b c d\nx y z w")], "src_id int, text string")
    b = spark.createDataFrame([(2, "a b q d\np q r s")], "doc_id int, text string")
    found = M.similarity_join(M.line_table(a, "src_id"), M.line_table(b, "doc_id"), M.SearchParams(rate=0.7, min_words=1, separators=True))
    assert [(r["src_line"], r["tgt_line"], r["match_words"], r["total_words"]) for r in found.collect()] == [(0, 0, 6, 7)]


def test_blanks_alone_can_reach_low_rates(spark):
    """Rates that no shared word is needed for: lengths alone prune, and nothing is lost."""
    from test_functions import table_lcs

    random.seed(10)
    make = lambda: " ".join(random.choice("abc") for _ in range(random.choice((1, 2, 3, 5, 8, 13))))
    src, tgt = [make() for _ in range(15)], [make() for _ in range(20)]
    a = M.line_table(spark.createDataFrame([(1, "\n".join(src))], "src_id int, text string"), "src_id")
    b = M.line_table(spark.createDataFrame([(2, "\n".join(tgt))], "doc_id int, text string"), "doc_id")
    blanks = lambda line: [x for w in line.split() for x in (w, " ")][:-1]
    for rate in (0.3, 0.4, 0.5, 0.55):
        want = set()
        for s, x in enumerate(src):
            for t, y in enumerate(tgt):
                if table_lcs(blanks(x), blanks(y)) / max(len(blanks(x)), len(blanks(y))) >= rate:
                    want.add((s, t))
        got = M.similarity_join(a, b, M.SearchParams(rate=rate, min_words=1, separators=True))
        assert {(r["src_line"], r["tgt_line"]) for r in got.collect()} == want, rate


def test_join_of_very_long_lines(spark):
    """Lines of 20,000 words on both sides, with words that repeat: rows hold ids, not lines, and none is lost."""
    random.seed(11)
    line = [f"w{random.randrange(30_000)}" for _ in range(20_000)]
    other = [w if random.random() < 0.8 else "z" for w in line]
    src = spark.createDataFrame([(1, " ".join(line) + "\n" + "same " * 20_000)], "src_id int, text string")
    tgt = spark.createDataFrame([(k, t) for k, t in enumerate([" ".join(other), "same " * 15_000, *(" ".join(random.sample(line, 20_000)) for _ in range(6))])], "doc_id int, text string")
    got = M.similarity_join(M.line_table(src, "src_id"), M.line_table(tgt, "doc_id"), M.SearchParams(rate=0.7, min_words=1)).collect()
    assert {(r["src_line"], r["doc_id"]): (r["match_words"], r["total_words"]) for r in got} == {(0, 0): (sum(a == b for a, b in zip(line, other)), 20_000), (1, 1): (15_000, 20_000)}


def test_work_grows_with_the_words_of_a_line(spark):
    """Rows of the candidate search for a line of n words, and twice as many: twice the rows."""
    made = []
    for n in (4_000, 8_000):
        src = M.line_table(spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(n)))], "src_id int, text string"), "src_id")
        tgt = M.line_table(spark.createDataFrame([(k, " ".join(f"a{i + k}" for i in range(n))) for k in range(4)], "doc_id int, text string"), "doc_id")
        where = M.postings(tgt)
        assert "words" not in where.columns
        keys = M.prefixes(src, M.frequencies(tgt, src.select(F.explode("words").alias("w"))), M.SearchParams(min_words=1))
        made.append((where.count(), keys.count()))
    assert made[1] == tuple(2 * x for x in made[0]) or all(b <= 2 * a + 2 for a, b in zip(*made))


def test_excluded_tables_leave_the_denominator(spark):
    text = "Alpha beta gamma delta\n1 2 3 4\n5 6 7 8"
    a, b = (spark.createDataFrame([(1, text)], f"{k} int, text string") for k in ("src_id", "doc_id"))
    for segmenter in (None, "plain", "full"):
        got = M.search(a, b, M.SearchParams(min_words=1, exclude_tables=True, segmenter=segmenter))[1].collect()
        assert [(r["match_count"], r["total"], r["rate"]) for r in got] == [(1, 1, 1.0)], segmenter
    first = spark.createDataFrame([(1, "1 2 3 4\nAlpha beta gamma delta")], "src_id int, text string")
    assert M.search(first, b, M.SearchParams(min_words=1, exclude_tables=True))[1].first()["total"] == 2


def test_accepted_zero_is_no_match(spark):
    a = spark.createDataFrame([(1, "a b\nc d\ne f")], "src_id int, text string")
    b = spark.createDataFrame([(1, "x y\nz q"), (2, "x y\nc d"), (3, "c d")], "doc_id int, text string")
    params = M.SearchParams(rate=0.0, min_words=1, accept_zero=True)
    matches, ranked = M.search(a, b, params)
    # The first line takes the first line of each document, whatever it holds.
    assert {(r["doc_id"], r["src_line"], r["tgt_line"]) for r in matches.collect()} == {(2, 1, 1)}
    assert [(r["doc_id"], r["match_count"], r["total"]) for r in ranked.collect()] == [(2, 1, 3)]
    walked = M.greedy(M.similarity_join(M.line_table(a, "src_id"), M.line_table(b, "doc_id"), params)).filter("rate > 0")
    assert {(r["doc_id"], r["src_line"], r["tgt_line"]) for r in walked.collect()} == {(2, 1, 1)}


def test_queue_of_searches_equals_single_ones(spark):
    random.seed(12)
    make = lambda: "\n".join(" ".join(random.choice(["alpha", "beta", "gamma", "データ", "の", "delta"]) for _ in range(random.randrange(2, 9))) for _ in range(6))
    src = spark.createDataFrame([(k, make()) for k in range(4)], "src_id int, text string")
    tgt = spark.createDataFrame([(k, "ab"[k % 2], make()) for k in range(12)], "doc_id int, scope string, text string")
    asked = [(10, 0, "a", False, 0.5, 3), (11, 0, "b", True, None, 2), (12, 1, "a", None, 0.8, None), (13, 2, "b", False, 1.0, 1), (14, 2, "b", True, 0.4, 5), (15, 3, "none", False, 0.5, 1)]
    queue = spark.createDataFrame(asked, "request_id int, src_id int, scope string, is_jp boolean, rate double, min_words int")
    default = M.SearchParams(rate=0.6, min_words=4)
    with M.search_queue(src, tgt, queue, default) as found:
        got = sorted((r["request_id"], r["doc_id"], r["src_line"], r["tgt_line"], r["rate"]) for r in found.matches.collect())
        ranks = sorted((r["request_id"], r["doc_id"], r["match_count"], r["total"]) for r in found.ranked.collect())
    want, totals = [], []
    for request, source, scope, is_jp, rate, least in asked:
        params = M.SearchParams(rate=default.rate if rate is None else rate, min_words=default.min_words if least is None else least, is_jp=bool(is_jp))
        matches, ranked = M.search(src.filter(f"src_id = {source}"), tgt.filter(F.col("scope") == scope), params)
        want += [(request, r["doc_id"], r["src_line"], r["tgt_line"], r["rate"]) for r in matches.collect()]
        totals += [(request, r["doc_id"], r["match_count"], r["total"]) for r in ranked.collect()]
    assert got == sorted(want) and ranks == sorted(totals) and len({g[0] for g in got}) >= 3


def test_zero_rate_tables_and_bounds(spark):
    a = spark.createDataFrame([(1, "a b c\n1 2 3\nx y z")], "src_id int, text string")
    b = spark.createDataFrame([(2, "a b d\n1 2 3")], "doc_id int, text string")
    src, tgt = M.line_table(a, "src_id"), M.line_table(b, "doc_id")
    pairs = lambda **k: sorted((r["src_line"], r["tgt_line"], round(r["rate"], 2)) for r in M.similarity_join(src, tgt, M.SearchParams(min_words=1, **k)).collect())
    assert pairs(rate=0.0) == [(0, 0, 0.67), (1, 1, 1.0)]
    assert pairs(rate=0.0, accept_zero=True) == [(0, 0, 0.67), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.0), (2, 1, 0.0)]
    assert pairs(rate=0.6, exclude_tables=True) == [(0, 0, 0.67)]
    ranked = M.rank(M.greedy(M.similarity_join(src, tgt, M.SearchParams(min_words=1))), a, M.totals(src, M.SearchParams(min_words=1)), b).collect()
    assert [(r["src_id"], r["doc_id"], r["match_count"], r["total"]) for r in ranked] == [(1, 2, 2, 3)]


def test_search_with_rough_filter_counts_rejected_lines(spark):
    text = "\n".join(f"word{i} alpha{i} beta{i} gamma{i} delta{i} eps{i}" for i in range(12))
    a = spark.createDataFrame([(1, text + "\nshort one")], "src_id int, text string")
    b = spark.createDataFrame([(7, text)], "doc_id int, text string")
    exact = M.search(a, b, M.SearchParams(rate=0.6, min_words=3))[1].first()
    assert (exact["match_count"], exact["total"], exact["rate"]) == (12, 12, 1.0)
    params = M.SearchParams(rate=0.6, min_words=3, rough_lines=4)
    got = M.search(a, b, params)[1].first()
    assert got["match_count"] == 12 and got["total"] >= 12
    assert replace(params, rough_lines=0).rough_lines == 0


def test_rough_blocks(spark):
    lines = spark.createDataFrame([(1, i, f"w{i}") for i in range(120)], "doc_id int, line_no int, text string")
    got = {r["start"]: len(r["block"].split()) for r in rough.target_blocks(lines, 5).collect()}
    assert got == {0: 55, 50: 55, 100: 20}


def test_levels_and_colours(spark):
    rates = [1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4, 0.1, 0.0]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, rate double")
    got = [r[0] for r in df.orderBy("i").select(R.level(F.col("rate"))).collect()]
    assert got == [0, 1, 1, 2, 2, 4, 4, 5, 6, 9, 9]
    shades = [r[0] for r in df.orderBy("i").select(R.colour(F.col("rate"))).collect()]
    assert shades[0] == "LightPink" and shades[2] == "Yellow" and shades[6] == "LightGreen" and shades[-1] == "White"


def segmented(spark, *texts, **k):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["text"] for r in L.segment_full(df, "id", **k).orderBy("id").collect()]


def test_segmenter(spark):
    table = "Title\n" + "\n".join("1 2 3" for _ in range(4)) + "\nEnd"
    got = segmented(spark, "One two. Three four.\nnext line", "alpha\nBeta gamma", "", "see fig. 3 here", None)
    assert got == ["One two.\nThree four. \nnext line ", "alpha\nBeta gamma ", "", "see fig. 3 here ", ""]
    assert "1 2 3" not in segmented(spark, table, exclude_tables=True)[0]


def test_runs_of_a_very_long_text(spark):
    """40,000 lines, every other one a number; the time is that of the lines."""
    text = "\n".join("12" if i % 2 else "word" for i in range(40_000))
    assert segmented(spark, text)[0].count("12") == 20_000
    lines = segmented(spark, "9\nA b\n7\n\nlower\n5", exclude_tables=True)[0]
    assert lines.startswith("9") and "7" not in lines and "5" not in lines


def test_rows_and_groups(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["p"] for r in df.select("id", L.rows(F.col("text")).alias("p")).collect()}
    assert got == {1: ["a", "b", "c"], 2: [], 3: None}
    g = spark.createDataFrame([("x  \ny\nz",)], "t string").select(L.paragraph_groups(F.col("t"))).first()[0]
    assert g == [0, 0, 1]


def test_every_line_is_found_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 20").select("doc_id", "text")
    lines = L.explode(docs, "doc_id", L.sentences(F.col("text"))).select("doc_id", F.col("line_no").alias("pattern_no"), F.col("text").alias("line"), F.lit(1.0).alias("rate"))
    got = P.located(lines.filter("line <> '' and not line rlike '^[0-9]'"), docs)
    assert got.filter("status = 'not found'").count() == 0
    assert got.filter("status = 'found'").count() > 50


def test_alignment_and_run_split(spark):
    assert P.aligned("a b c", "abc", 2, 4) == (1, 2)
    assert P.aligned("abc", "xyz", 0, 1) == (0, 2)
    assert P.aligned("abc", "abc", 0, 5) == (-1, -1)
    r = spark.createDataFrame([("hello",)], "t string").select(P.split_run(F.col("t"), F.lit(1), F.lit(3)).alias("s")).first()[0]
    assert (r["before"], r["inside"], r["after"]) == ("h", "ell", "o")


def test_all_patterns_at_once_equal_single_ones(spark):
    random.seed(15)
    for _ in range(400):
        text = "".join(random.choice(["a", "b", " ", "  ", ".", "'", "‘", '"', "–", "1", "2", "\n", "(", "\u3000"]) for _ in range(60))
        lines = ["".join(random.choice("ab .'\"12(") for _ in range(random.randrange(1, 5))).strip() for _ in range(8)] + [None, "", "®"]
        lines = [x if x is None or x.strip() else None for x in lines]
        assert P.all_spans(lines, text) == [P.spans(x, text) for x in lines], (lines, text)
    texts = spark.createDataFrame([(1, "one two  three. four"), (2, None), (3, "x")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, 1, "two three"), (1, 2, "four"), (1, 3, None), (2, 1, "a b"), (3, 1, "x"), (9, 1, "x")], "doc_id int, n int, search string")
    got = {(r["doc_id"], r["n"]): [(s["begin"], s["end"]) for s in r["spans"]] for r in P.spans_in(asked, texts, ["n"]).collect()}
    assert got == {(1, 1): [(4, 13)], (1, 2): [(16, 19)], (1, 3): [], (2, 1): [], (3, 1): [(0, 0)]}


def naive_paragraphs(pieces, paragraphs):
    out, place, least = [], -1, 0
    for piece in pieces:
        head = piece.strip()[: P.HEAD]
        hits = [i for i, x in enumerate(paragraphs) if i >= least and head and head in x]
        if hits:
            place = hits[0]
            if piece.rstrip().endswith("."):
                least = place + 1
        out.append(place)
    return out


def naive_lines(pieces, lines):
    out, least = [], (0, 0)
    bare = [x.strip().strip(".") for x in lines]
    for piece in pieces:
        head = piece.strip().strip(".")[: P.HEAD]
        places = [(k, i) for k, x in enumerate(bare) for i in range(len(x)) if head and x.startswith(head, i) and (k, i) >= least]
        out.append(places[0][0] if places else -1)
        if places:
            k, i = places[0]
            least = (k, i + len(piece)) if i + len(piece) < len(bare[k]) else (k + 1, 0)
    return out


def test_places_by_brute_force():
    random.seed(14)
    for _ in range(300):
        make = lambda n: "".join(random.choice("ab. ") for _ in range(random.randrange(n)))
        pieces, lines = [make(8) for _ in range(12)], [make(30) for _ in range(8)]
        assert P.forward_paragraphs(pieces, lines) == naive_paragraphs(pieces, lines)
        assert P.forward_lines(pieces, lines) == naive_lines(pieces, lines)


def test_places_in_order():
    paragraphs = ["one two. three four.", "five six", "one two. again."]
    assert P.forward_paragraphs(["one two.", "three four", "five", "zzz", "again."], paragraphs) == [0, 0, 1, 1, 2]
    assert P.forward_paragraphs(["five six", "one two."], paragraphs) == [1, 0]
    assert P.forward_lines(["one two", "three four", "five six", "nothing"], ["one two. three four.", "five six"]) == [0, 0, 1, -1]


def test_requests_segmenters_and_own_release(spark):
    line = "Alpha beta gamma delta epsilon zeta."
    src = spark.createDataFrame([(1, line), (2, line)], "src_id int, text string")
    tgt = spark.createDataFrame([(7, f"{line}\n{line}"), (8, line), (9, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, 8), (1, 8), (2, 7)], "src_id int, doc_id int")
    params = M.SearchParams(min_words=3)
    for p in (params, replace(params, segmenter="plain"), replace(params, segmenter="full"), replace(params, rough_lines=5)):
        matches, ranked = M.search(src, tgt, p, asked)
        assert sorted((r["src_id"], r["doc_id"]) for r in ranked.collect()) == [(1, 8), (2, 7)]
        assert sorted((r["src_id"], r["doc_id"], r["rate"]) for r in matches.collect()) == [(1, 8, 1.0), (2, 7, 1.0)]
    one, two = M.search(src, tgt, params), M.search(src, tgt, params)
    with one:
        assert one.matches.count() == 4
    assert not one.kept.frames and two.kept.frames and two.ranked.count() == 4
    two.release()


def test_pairs_are_made_once(spark):
    src = spark.createDataFrame([(1, "a a b c d e"), (2, "a b"), (3, "")], "src_id int, text string")
    tgt = spark.createDataFrame([(5, "a a b c d e"), (6, "e d c b a a"), (7, "a b c"), (8, "")], "doc_id int, text string")
    for rate in (0.1, 0.5, 0.9):
        got = M.candidates(M.line_table(src, "src_id"), M.line_table(tgt, "doc_id"), M.SearchParams(rate=rate, min_words=1)).collect()
        pairs = [(r["src_id"], r["src_line"], r["doc_id"], r["tgt_line"]) for r in got]
        assert len(pairs) == len(set(pairs)) > 0


def test_rough_walk_of_many_blocks_is_quick():
    """Every pair of blocks as by a plain walk; 10,000 pairs over blocks of 3,000 signs in seconds."""
    import random
    import time

    def plain_walk(words, block):
        pos = hits = 0
        for i, w in enumerate(words):
            at = pos + 1 if w == "" else block.find(w, pos) + 1
            pos, hits = at or pos, hits + (at > 0)
            if (i == len(words) - 1 or i > rough.WORDS // 2) and hits * 2 < i:
                return False
            if len(block) <= pos:
                return True
        return True

    random.seed(3)
    word = lambda: "".join(random.choice("abcd😀") for _ in range(random.randrange(5)))
    for size, times in ((8, 200), (600, 100)):
        groups = [[word() for _ in range(random.randrange(1, 21))] for _ in range(100)]
        blocks = [" ".join(word() for _ in range(random.randrange(size))) + " " for _ in range(times)]
        began = time.time()
        got = [rough.passing(groups, b) for b in blocks]
        assert time.time() - began < 20
        assert got == [[k for k, g in enumerate(groups) if plain_walk(g, b)] for b in blocks]


def plain_rough_walk(words, block):
    pos = hits = 0
    for i, w in enumerate(words):
        at = pos + 1 if w == "" else block.find(w, pos) + 1
        pos, hits = at or pos, hits + (at > 0)
        if (i == len(words) - 1 or i > rough.WORDS // 2) and hits * 2 < i:
            return False
        if len(block) <= pos:
            return True
    return True


def test_rough_walk_of_odd_words():
    """Words of several bytes and beyond ``LONG``, empty ones, a last block without a word, single signs."""
    random.seed(12)
    for signs in ("ab", "aé語😀", "a\0\n\x85"):
        word = lambda: "".join(random.choice(signs) for _ in range(random.choice([0, 1, 2, 3, 3, rough.LONG + 2])))
        for size in (0, 3, 40):
            walk = rough.Walk(groups := [[word() for _ in range(random.randrange(1, 21))] for _ in range(40)] + [[""], ["", ""]])
            blocks = ["".join(word() + " " for _ in range(random.randrange(size + 1))) + " " * random.randrange(1, 4) for _ in range(30)]
            assert walk.passing(blocks).tolist() == [[plain_rough_walk(g, b) for g in groups] for b in blocks]


def test_rough_walks_of_a_bunch_are_quick():
    """256 source blocks with 2,500 words through 1,000 target blocks of 2,500 signs; one by one it took 8 ms each."""
    import time

    random.seed(4)
    known = ["".join(random.choice("etaoinshr") for _ in range(random.randrange(2, 9))) for _ in range(5000)]
    words = [[random.choice(known) for _ in range(20)] for _ in range(256)]
    docs = [[" ".join(random.choice(known) for _ in range(450)) + " "] for _ in range(1000)]
    group = rough.Group("\n\n".join(f"-1 4 {' '.join(w)}" for w in words))
    began = time.time()
    doc, at = group.marked(docs)
    assert time.time() - began < 4
    took = sorted(set(zip(doc.tolist(), group.source[at].tolist())))
    assert [x for x in took if x[0] < 20] == [(d, k) for d in range(20) for k, w in enumerate(words) if plain_rough_walk(w, docs[d][0])]


def test_rough_lines_come_once_without_a_shuffle(spark, monkeypatch):
    """Long sources, documents of more blocks and of more rows, bunches and groups of any size: each marked line once,
    and nothing is shuffled or compared behind the walks."""
    random.seed(9)
    text = lambda n: [" ".join(random.choice("abcdefgh") * random.randrange(1, 4) for _ in range(random.randrange(5))) for _ in range(n)]
    sources = {k: text(n) for k, n in enumerate((1, 5, 6, 23, 64))}
    docs = [(k % 12, text(random.choice([1, 2, 60, 130]))) for k in range(16)] + [(77, []), (78, None), (None, text(3))]
    lines = [(k, i, x) for k, xs in sources.items() for i, x in enumerate(xs)]
    src = spark.createDataFrame(lines, "src_id long, line_no int, idx string")
    tgt = spark.createDataFrame(docs, "doc_id long, lines array<string>")
    blocks = [(r["src_id"], r["first"], r["last"], r["words"]) for r in rough.source_blocks(src, 5).collect()]
    exploded = tgt.select("doc_id", F.posexplode("lines").alias("line_no", "text"))
    want = set()
    for d in rough.target_blocks(exploded, 5).collect():
        want |= {(s, d["doc_id"], n) for s, first, last, words in blocks if plain_rough_walk(words, d["block"]) for n in range(first, last + 1)}
    for group, bunch in ((256, 64), (2, 3)):
        monkeypatch.setattr(rough, "GROUP", group)
        monkeypatch.setattr(rough, "BUNCH", bunch)
        df = rough.rough_lines(src, tgt, 5)
        got = [tuple(r) for r in df.select("src_id", "doc_id", "line_no").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
        assert df._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    texts = spark.createDataFrame([(1, "one. Two"), (2, None), (3, "")], "doc_id long, text string")
    df = rough.rough_lines(src, texts.select("doc_id", L.sentences(F.col("text")).alias("lines")), 5)
    cuts = [x._jdf.queryExecution().optimizedPlan().toString().count("([A-Z])") for x in (df, texts.select(L.sentences(F.col("text")).alias("lines")))]
    assert cuts[0] == cuts[1] > 0 and {r["doc_id"] for r in df.collect()} <= {1}


def test_rough_search_looks_at_documents_with_pairs_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rough, "rough_lines", lambda s, t, r, f=rough.rough_lines: seen.append(t.select("doc_id").distinct().count()) or f(s, t, r))
    src = spark.createDataFrame([(1, "one two three four five six")], "src_id long, text string")
    tgt = spark.createDataFrame([(i, "one two three four five six" if i == 7 else f"x{i} y z one") for i in range(50)], "doc_id long, text string")
    got = M.search(src, tgt, M.SearchParams(rate=0.6, min_words=2, rough_lines=5))[1].collect()
    assert [(r["doc_id"], r["match_count"], r["total"]) for r in got] == [(7, 1, 1)] and seen == [1]


def test_accepted_zero_is_counted_without_scores(spark):
    random.seed(8)
    make = lambda: "\n".join(random.choice(["", "1 2", ". .", " ".join(random.choice("abcde") for _ in range(3))]) for _ in range(7))
    a = spark.createDataFrame([(k, make()) for k in range(6)], "src_id int, text string")
    b = spark.createDataFrame([(k, make()) for k in range(20)] + [(90, None)], "doc_id int, text string")
    params = M.SearchParams(rate=0.0, min_words=1, accept_zero=True, exclude_tables=True)
    matches, ranked = M.search(a, b, params)
    assert "lcs_arrow" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    src, tgt = (M.line_table(d, c) for d, c in ((a, "src_id"), (b, "doc_id")))
    walked = M.greedy(M.similarity_join(M.eligible(src, params), tgt, params)).filter("rate > 0").collect()
    assert sorted(walked) == sorted(matches.select(walked[0].__fields__).collect())
    assert sum(r["match_count"] for r in ranked.collect()) == len(walked) > 20


def counted(spark, df):
    """``df`` and a count of its rows as they are made."""
    made = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(look, df.schema), made


def test_documents_are_read_once(spark):
    """A join reads and cuts each document once; lines that cannot reach the rate are not kept."""
    random.seed(21)
    src = spark.createDataFrame([(1, "a b b c\nd e f g h")], "src_id int, text string")
    texts = [" ".join(random.choice("abcdefghxyz") for _ in range(6)) for _ in range(30)] + ["b  a b c ", "x y z a", "h g f e d", "d e f h"]
    docs, made = counted(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    params, kept = M.SearchParams(rate=0.6, min_words=1), M.Kept()
    a, b = M.line_table(src, "src_id"), M.line_table(docs, "doc_id")
    got = M.similarity_join(a, b, params, kept=kept).collect()
    assert {(r["src_line"], r["doc_id"]) for r in got} == naive_pairs(["a b b c", "d e f g h"], texts, 0.6)
    assert made.value == len(texts)
    kept.release()
    _, lines, _ = M.numbered(a, b, list("abcdefgh"), params, kept)
    assert {r["doc_id"] for r in lines.collect()} == {k for k, t in enumerate(texts) if sum(w in "abcdefgh" for w in t.split()) >= 0.6 * len(t.split())}
    kept.release()


def test_queue_cuts_asked_scopes_only(spark):
    """A queue reads the documents once for each form of lines, and cuts those of scopes asked for in that form."""
    src = spark.createDataFrame([(1, "a b c d")], "src_id int, text string")
    rows = [(1, "x", "a b c d"), (2, "y", "a b c e"), (3, "z", "a b c d")]
    docs, made = counted(spark, spark.createDataFrame(rows, "doc_id int, scope string, text string"))
    queue = spark.createDataFrame([(10, 1, "x", False, 0.6, 1), (11, 1, "y", True, 0.6, 1)], "request_id int, src_id int, scope string, is_jp boolean, rate double, min_words int")
    with M.search_queue(src, docs, queue) as found:
        assert sorted((r["request_id"], r["doc_id"], r["match_words"]) for r in found.matches.collect()) == [(10, 1, 4), (11, 2, 3)]
        assert made.value <= 2 * len(rows)


def test_pivot_makes_matches_once(spark):
    rows = [(1, 0, 5, 0, 4, 4, 1.0), (1, 1, 5, 2, 3, 4, 0.75), (1, 0, 6, 1, 4, 4, 1.0)]
    matches, made = counted(spark, spark.createDataFrame(rows, "src_id int, src_line int, doc_id int, tgt_line int, match_words int, total_words int, rate double"))
    total = spark.createDataFrame([(1, 2)], "src_id int, total int")
    got = R.pivot(matches, M.matched_rank(matches, total)).collect()
    assert sorted((r["doc_id"], r["l0"], r["l3"], r["total_words"]) for r in got) == [(5, 4, 3, 7), (6, 4, 0, 4)]
    assert made.value == len(rows)


def test_zero_rows_of_the_ranking_are_not_moved(spark):
    matches = spark.createDataFrame([(1, 0, 5, 0, 4, 4, 1.0)], "src_id int, src_line int, doc_id int, tgt_line int, match_words int, total_words int, rate double")
    sources, docs = spark.createDataFrame([(1,), (2,)], "src_id int"), spark.createDataFrame([(5,), (6,)], "doc_id int")
    total = spark.createDataFrame([(1, 2)], "src_id int, total int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.rank(matches, sources, total, docs)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["src_id"], r["doc_id"], r["match_count"], r["total"]) for r in out.collect()) == [(1, 5, 1, 2), (1, 6, 0, 2), (2, 5, 0, 0), (2, 6, 0, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
