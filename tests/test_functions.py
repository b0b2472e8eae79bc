"""Hand-derived vectors for scalar functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import normalize as N
from palimpsest.functions import similarity as S
from palimpsest.functions import symbols as Y
from palimpsest.functions import tokens as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()[0]


def many(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select(f(F.col("t")).alias("r"), "i").orderBy("i").select("r").collect()]


WORDS = {
    "Größe über": "Gr öß e ü ber",
    "a b.": "a b ",
    "患者のデータを。": "患者 の データ を ",
    "データベース": "データベース",
    "すーぱー": "す ー ぱ ー",
    "(1) foo-bar, baz@x.y": "1 foo-bar baz@x y",
    "": "",
    "...": "",
    "漢。": "漢",
    "漢。 ": "漢 ",
    "été": "é t é",
}


def test_split_words(spark):
    assert many(spark, list(WORDS), T.split_words) == list(WORDS.values())
    counts = many(spark, list(WORDS.values()), T.word_count)
    assert counts == [5, 3, 5, 1, 4, 4, 1, 1, 1, 2, 3]


def test_widths(spark):
    assert one(spark, "ＡＢ　", N.zen_to_han) == "AB "
    assert one(spark, "ｶﾞ｡", N.han_to_zen) == "カ゛。"


def test_cleanup_and_separators(spark):
    assert one(spark, "  a   b\n c - d ", N.cleanup) == "a b\nc - d"
    assert many(spark, ["abc。  ", "abc.  ", "a)  ", "x"], N.trim_separator) == ["abc。", "abc.  ", "a)", "x"]
    assert many(spark, ["abc.  ", "abc)  ", "abc"], N.display_feed) == ["abc.  ", "abc)", "abc\n"]


def test_symbols(spark):
    assert many(spark, ["F061", "F02A", "F0FF", "41", "xyz"], Y.from_symbol_code) == ["α", "∗", " ", "41", "xyz"]
    assert one(spark, "abG", Y.from_symbol_font) == "αβΓ "
    assert many(spark, ["α", "a", "∞"], Y.is_special) == [True, False, True]


def pair(spark, a, b, separators=False):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(T.pieces(F.col("a")).alias("x"), T.pieces(F.col("b")).alias("y"))
    x, y = (S.with_blanks(F.col("x")), S.with_blanks(F.col("y"))) if separators else (F.col("x"), F.col("y"))
    df = df.withColumn("l", S.lcs_native(x, y)).withColumn("l2", S.lcs_arrow(x, y))
    m, t, r = S.word_rate(F.col("x"), F.col("y"), F.col("l"), separators)
    got = df.select(m, t, r, F.col("l") == F.col("l2")).first()
    assert got[3]
    return got[0], got[1], round(got[2], 4)


@pytest.mark.parametrize(
    "a, b, words, with_blanks",
    [
        ("the quick brown fox", "the quick brown fox", (4, 4, 1.0), (7, 7, 1.0)),
        ("the quick brown fox jumps", "the quick red fox jumps", (4, 5, 0.8), (8, 9, 0.8889)),
        ("a b c", "a b c d", (3, 4, 0.75), (5, 7, 0.7143)),
        ("a b c", "x y z", (0, 3, 0.0), (2, 5, 0.4)),
    ],
)
def test_line_similarity(spark, a, b, words, with_blanks):
    assert pair(spark, a, b) == words
    assert pair(spark, a, b, True) == with_blanks


def test_char_similarity(spark):
    rows = [("abcd", "abcd"), ("abcd", "abxd"), ("abc", "abcdef")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("l", S.lcs_chars_arrow("a", "b"))
    assert [r[0] for r in df.select(S.char_rate(F.col("a"), F.col("b"), F.col("l"))[2]).collect()] == [1.0, 0.5, 0.0]


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_bit_parallel_lcs(a, b):
    assert S.lcs_length(a, b) == table_lcs(a, b) == S.lcs_length(b, a)


def test_common_substring_and_offset():
    assert S.common_substring("a b c d", "xbcdx") == 3
    assert S.common_substring("", "x") == 0
    assert S.overlap_offset("hello world", "world") == 6
    assert S.overlap_offset("world", "hello world") == -6
    assert S.overlap_offset("abc", "xyz") is None


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(N.line(F.col("t"))).first()[0] == ""
    assert df.select(N.strip_all(F.col("t"))).first()[0] == ""



def naive_run(a, b):
    a, b = "".join(a.split()), "".join(b.split())
    return max((k for i in range(len(a)) for k in range(len(a) - i + 1) if a[i : i + k] in b), default=0)


def naive_offset(a, b):
    least = naive_run(a, b)
    for x, y, sign in ((a, b, 1), (b, a, -1)):
        whole, places = S.bared(x)
        for size in range(len(y), max(least, 1) - 1, -1):
            part, own = S.bared(y[:size])
            i = whole.find(part) if part else -1
            if i >= 0 and places[i] - own[0] >= 0:
                return sign * (places[i] - own[0])
    return None


def test_runs_and_overlaps_by_brute_force():
    random.seed(16)
    for _ in range(1500):
        a, b = ("".join(random.choice("abc .-Ａ’\u3000😀") for _ in range(random.randrange(14))) for _ in range(2))
        assert S.common_substring(a, b) == naive_run(a, b), (a, b)
        assert S.overlap_offset(a, b) == naive_offset(a, b), (a, b)


def test_overlap_keeps_letters_and_drops_signs():
    """By hand from the reference's rule: every letter counts, an @ does not (F4: the SQL twin has it the other way)."""
    assert S.overlap_offset("That er, ating, reor anoutiing ston erou, the in thenti enwh thoushhe ananat.", "Th toonenouwh in thou anedtion thedthea a.") is None
    assert S.overlap_offset("Thatat.", "That.") == 0
    assert S.overlap_offset("x@a b", "a@b") == 2
    assert S.overlap_offset("a@b", "x@a b") == -2


def test_runs_of_long_texts_are_linear():
    import time

    texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(n)) for n in (20_000, 20_000)]
    began = time.time()
    assert S.common_substring(texts[0], texts[0][100:] + texts[1]) == len("".join(texts[0][100:].split()))
    assert S.overlap_offset(texts[0], texts[0][100:] + texts[1]) == 100 and time.time() - began < 20


def test_prefix_lcs_by_table_and_of_long_lines(spark):
    import time

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + 1 if x.startswith(y) or y.startswith(x) else 0, row[j + 1], new[j]))
            row = new
        return row[-1]

    random.seed(5)
    for _ in range(1000):
        a, b = (["".join(random.choice("ab😀") for _ in range(random.randrange(1, 4))) for _ in range(random.randrange(9))] for _ in range(2))
        assert S.prefix_lcs_length(a, b) == table(a, b), (a, b)
    words = [f"w{random.randrange(10**4)}" for _ in range(3000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(w + "x" for w in words[100:]))], "a string, b string")
    began = time.time()
    assert df.select(*S.prefix_lcs(F.col("a"), F.col("b"))).first()[0] >= 2900 and time.time() - began < 20


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_and_lines_are_cut_once(spark):
    from palimpsest.operators import lines as L

    df = spark.createDataFrame([("a b. C d.\r\n\r\ne,",), ("",), (None,), ("x",)], "t string")
    assert plan(df.select(T.split_words(F.col("t")).alias("x"))).count("regexp_extract_all") == 1
    assert plan(df.select(F.explode(L.rows(F.col("t"))))).count("split(") == 1
    assert [r[0] for r in df.select(L.sentences(F.col("t"))).collect()] == [["a b.", "C d.", "", "e,"], [], None, ["x"]]
    assert [r[0] for r in df.select(T.split_words(F.col("t"))).collect()] == ["a b C d e ", "", None, "x"]


def test_lines_are_bared_once(spark, sf_dir):
    from palimpsest.plans import catalogue

    assert plan(catalogue.containment(spark, sf_dir)).count("\\x{25A0}") == 1
    texts = ["", "a-b (c)", "Größe, À × ÷.", "x∆y ‘q’ Ａ　ﾊ", "\x00z\t\xad‎¶", "é!\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = N.strip_symbols(N.short_line(N.strip_math(F.col("t"))))
    for got, want, bare in df.select(N.strip_all(F.col("t")), whole, N.bare(F.col("t"))).collect():
        assert got == want and bare == "".join(got.split())
