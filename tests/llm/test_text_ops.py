"""Personal data, quality rules, subwords and chat forms: row-wise functions against plain forms."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import chat, pieces, pii, queries, rules

EDGE = [(1, None), (2, ""), (3, "word"), (4, "aa bb cc dd ee ff gg hh ii jj kk ll"), (4, "aa bb cc dd ee ff gg hh ii jj kk ll"), (None, "x y"), (5, "long " * 60_000)]


def edge_table(spark, clash="kept boolean, id string, spans string"):
    names = [c.split()[0] for c in clash.split(", ")]
    rows = [(i, t, "en", "s", 0, *[None] * len(names)) for i, t in EDGE]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clash}")


# ---- personal data -------------------------------------------------------------------------


def base_by_regex(text):
    """The base written down plainly."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text("aZ0129.@-+ ()%é", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == base_by_regex(text)
    assert set(pii.spans(text)[1]) >= set(pii.spans(text)[0])


def test_base_spans_of_numbers():
    random.seed(3)
    for _ in range(300):
        text = " ".join("".join(random.choice("0123456789 -.+") for _ in range(random.randrange(10, 40))) for _ in range(4))
        assert pii.base_spans(text) == base_by_regex(text)


def test_phone_of_digits_far_apart():
    text = "call +1 (2) (3) (4) (5) (6) (7) (8) (9) (0)"
    assert pii.base_spans(text) == base_by_regex(text) == [(5, len(text) - 1, "phone")]


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("john.doe at example dot com", "email", "john.doe at example dot com"),
        ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus four nine one seven two five five five one two three four ok", "phone", "plus four nine one seven two five five five one two three four"),
        ("host 192[.]168[.]1[.]10 up", "ip", "192[.]168[.]1[.]10"),
        ("ten 10 dot 0 dot 0 dot 1 end", "ip", "10 dot 0 dot 0 dot 1"),
        ("john at mail dot a dot b dot c dot d dot e ok", "email", "john at mail dot a dot b dot c dot d dot e"),
        ("x " + "a" * 80 + " [at] example [dot] com", "email", "a" * 80 + " [at] example [dot] com"),
        ("call +49 171 five five six 1234567 now", "phone", "+49 171 five five six 1234567"),
        ("u​ser@ex​ample.com", "email", "u​ser@ex​ample.com"),
    ],
)
def test_disguises(text, kind, part):
    assert [(k, text[s:e]) for s, e, k in pii.spans(text)[1]] == [(kind, part)]


@pytest.mark.parametrize("text", ["he sat at home. The dot is there", "look at me. dot com", "one two three", "un deux trois quatre", "", "at", "1.2.3.999", "[" + ", ".join(["null"] * 16) + "]", "null " * 16, "one, two, three, four, five, six, seven, eight, nine, one, two, three, four, five", "x at y", "a dot b dot c"])
def test_clean_texts_stay(text):
    assert pii.spans(text)[1] == [] and pii.redact(text) == text


def test_disguises_by_construction():
    """Addresses and numbers disguised at random inside filler: the added spans are exactly the planted ones."""
    random.seed(21)
    digits = ["zero one two three four five six seven eight nine".split(), "null eins zwei drei vier fünf sechs sieben acht neun".split()]
    name = lambda: "".join(random.choice("abcxyz019") for _ in range(random.randrange(1, 9))) + "k"
    for _ in range(400):
        text, want = "", []
        for _ in range(random.randrange(1, 5)):
            text += " ".join(random.choice(["word", "Haus", "maison", "casa", "9"]) for _ in range(random.randrange(1, 5))) + "; "
            if random.random() < 0.7:
                dots = [random.choice([" dot ", " [dot] ", "(dot)", "[.]", " punkt "]) for _ in range(random.randrange(1, 7))]
                part = name() + random.choice([" at ", " [at] ", "(at)", "[@]", " @ "]) + name() + "".join(d + name() for d in dots)
                kind = "email"
            else:
                table, n = random.choice(digits), random.randrange(9, 14)
                part = "plus " + " ".join(table[d] for d in [1, 2, *(random.randrange(10) for _ in range(n - 1))])
                kind = "phone"
            want.append((len(text), len(text) + len(part), kind))
            text += part + " ; "
        assert pii.spans(text)[1] == want, text


def test_many_spans_are_linear():
    import time

    text = "аб " + "x@example.com " * 40_000
    began = time.process_time()
    assert len(pii.spans(text)[1]) == 40_000 and time.process_time() - began < 5


def test_pii_long_text_is_linear():
    assert pii.spans(("a" * 100_000 + " at ") * 20)[1] == [] and pii.spans(" [dot] b" * 100_000)[1] == []
    assert pii.spans("five " * 300_000 + "[at]")[1] == []
    assert pii.spans("a" * 2_000_000 + "1" * 500_000 + "." * 100_000)[1] == []


def test_pii_tables(spark):
    docs = edge_table(spark)
    got = {r["id"]: r for r in pii.find(docs).collect()}
    assert len(got) == 6 and all(r["base"] == [] for r in got.values())
    assert pii.find(docs.limit(0)).count() == 0
    dirty = spark.createDataFrame([(1, "a@b.com and +1 (377) 555-0271", 5)], "doc_id bigint, text string, n_chars bigint")
    row = pii.redacted(dirty).first()
    assert row["text"] == "[EMAIL] and [PHONE]" and row["n_chars"] == len(row["text"])
    assert pii.redacted(docs).columns == docs.columns


def test_op2_on_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_pii_spans(spark, sf_dir).collect():
        base = base_by_regex(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]


# ---- quality rules -------------------------------------------------------------------------


def measures_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=400, deadline=None)
@given(st.text("ab \n\té#|", max_size=120))
def test_measures(text):
    m = rules.Measures(text)
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == measures_by_hand(text)


def test_order_never_changes_the_verdict():
    random.seed(2)
    texts = [" ".join(random.choice(["the", "THE!!", "a|", "***", "word", "x"]) for _ in range(random.randrange(0, 60))) for _ in range(200)]
    for _ in range(5):
        order = list(rules.RULES)
        random.shuffle(order)
        assert [rules._verdict(rules.Measures(t), tuple(order)) for t in texts] == [rules._verdict(rules.Measures(t), rules.plan(texts)) for t in texts]


def test_rules_tables(spark):
    docs = edge_table(spark)
    got = {(r["doc_id"], r["n_words"]): r for r in rules.scored(docs).collect()}
    assert got[1, 0]["base_failed"] and not got[1, 0]["kept"] and got[4, 12]["kept"] and not got[5, 60_000]["kept"]
    kept = rules.passing(docs)
    assert kept.columns == docs.columns and kept.count() == 2  # the repeated row stays twice
    assert rules.scored(docs.limit(0)).count() == 0 and rules.passing(docs.limit(0)).count() == 0


def test_op5_equals_sql(spark, sf_dir, duck):
    from conftest import check_oracle

    check_oracle(queries.op5_quality_rules(spark, sf_dir), duck, queries.ORACLES["op5_quality_rules"])


# ---- subwords ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model")
    return pieces.load()


ODD = ["", " ", "  ", " a", "a  b", "日本語😀", "a\x00b\x01", "\n\n\t x", "<s> </s> <0x41>", "trailing   ", "é" * 5, "▁▁a", "▁", "\0", "a \0 b", "x" * 3000]


def test_parity_and_round_trip(model):
    c = pieces.Codec(model, 1)
    ids, same = c.encode(ODD)
    assert all(same) and ids == c.check.encode(ODD)
    assert [c.spell(x) for x in ids] == c.decode(ids) == [t.replace("▁", " ") for t in ODD]
    whole = [e.ids for e in c.fast.encode_batch(ODD, add_special_tokens=False)]
    assert whole == ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_parity_on_any_text(texts):
    import os

    if os.path.exists(pieces.MODEL):
        c = pieces.codec(pieces.load(), 1)
        texts = [t.encode("utf-8", "ignore").decode() for t in texts]
        ids, _ = c.encode(texts)
        assert ids == c.check.encode(texts)


def test_parity_is_of_whole_texts(model, monkeypatch):
    """A wrong split of a text or a wrong word in the cache shows; sentencepiece's ids stand."""
    text = "some words of a text"
    c = pieces.Codec(model, 1)
    assert c.encode([text])[1] == [True]
    c.known["words"] = c.known["text"]
    ids, same = c.encode([text, "other ones"])
    assert same == [False, True] and ids[0] == c.check.encode(text)
    c = pieces.Codec(model, 1)
    monkeypatch.setattr(pieces, "_CHUNK", re.compile("[a-z]+"))
    text = "some  words of a text"
    ids, same = c.encode([text])
    assert same == [False] and ids[0] == c.check.encode(text)


def test_ids_are_the_tokenizers_librarys(model, monkeypatch):
    """Without sentencepiece the same ids come out; with the encoding stubbed they don't."""
    c = pieces.Codec(model, 1)
    theirs = c.check.encode(ODD)
    monkeypatch.setattr(c, "check", None)
    assert [np.frombuffer(x, np.int32).tolist() for x in c.ids_of(ODD)] == theirs
    monkeypatch.setattr(pieces.Codec, "_whole", lambda self, normal: [b"" for _ in normal])
    monkeypatch.setattr(pieces.Codec, "learn", lambda self, words: self.known.update((w, b"") for w in words))
    c = pieces.Codec(model, 1)
    assert not any(np.frombuffer(x, np.int32).tolist() == y for x, y in zip(c.ids_of(ODD), theirs) if y)


def test_worker_tables_are_bounded(model, monkeypatch):
    """Words, texts without blanks and texts with double blanks all count, by bytes."""
    monkeypatch.setattr(pieces, "KNOWN_BYTES", 1 << 20)
    c = pieces.Codec(model, 1)
    for k in range(40):
        c.ids_of([" ".join(f"w{k}x{i}" for i in range(500)), "  ".join(f"d{k}x{i}" for i in range(500)), f"{k}" + "y" * 30_000])
        used = sum(len(w) + len(x) for t in (c.known, c.chunks) for w, x in t.items())
        assert used <= c.held <= (1 << 20) + 500_000


def test_unigram_model_is_rebuilt():
    """A unigram model written by hand, byte by byte."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))

    data = piece("<unk>", 0, 2) + piece("▁a", -1, 1) + piece("b", -2, 1) + piece("▁", -3, 1) + piece("a", -2.5, 1) + piece("ab", -2.2, 1) + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    m = pieces.parse(data)
    assert m.kind == 1 and not m.squeeze and len(m.pieces) == 6
    c = pieces.Codec(data, 1)
    texts = ["ab", "a b ab", "abab", "zz a", ""]
    assert c.encode(texts)[0] == c.check.encode(texts) == [e.ids for e in c.fast.encode_batch(texts, add_special_tokens=False)]


def test_unigram_model_with_other_pieces():
    """Control, unused, byte and user pieces: ids are always sentencepiece's, and ordinary texts agree."""
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, *([len(data)] if len(data) < 128 else [len(data) & 127 | 128, len(data) >> 7])]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))

    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("ab", 0, 5) + piece("<sep>", 0, 4)
    data += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    data += b"".join(piece(p, -k, 1) for k, p in enumerate(("▁a", "b", "▁", "a", "<", "s", ">", "ba"), 1))
    data += field(2, b"\x18\x01\x98\x02\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    c = pieces.Codec(data, 1)
    texts = ["ab ba", "a <s> b", "é ab", "<0x41> a", "a <sep> b", "", "aé<s>"]
    ids, same = c.encode(texts)
    assert ids == c.check.encode(texts)
    assert same[:3] == [True] * 3 and same[5:] == [True] * 2
    assert c.decode(ids)[:3] == texts[:3]


def test_subword_tables(spark, model):
    docs = edge_table(spark, "ids string, parity int")
    got = {r["doc_id"]: r for r in pieces.encoded(docs).collect()}
    assert got[1]["ids"] == [] and got[1]["decoded"] == "" and got[5]["decoded"] == "long " * 60_000 and all(r["parity"] for r in got.values())
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_op1_on_table(spark, sf_dir, model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    c = pieces.Codec(model, 1)
    for r in queries.op1_sentencepiece(spark, sf_dir).collect():
        ids = c.check.encode(texts[r["doc_id"]])
        assert r["parity"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# ---- chat ----------------------------------------------------------------------------------

BITS = ["\\", *chat.CONTROL, " ", "a", "\n", "]", "[", "<", "INST]", "/s>", "é"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "x]y", ""]), st.lists(st.sampled_from(BITS), max_size=8).map("".join)), max_size=5))
def test_template_reads_back(turns):
    s = chat.OPEN + "".join(chat.render(r, t) for r, t in turns)
    got = list(chat.parse(s))
    assert [(r, t) for r, t, _ in got] == turns
    assert [chat.unescape(s[m[0] : m[1]]) for _, _, m in got if m] == [t for r, t in turns if r == "assistant"]


def test_events_are_folded(spark):
    log = [
        (1, 1, "message", "m1", "user", "hi"),
        (1, 2, "delta", "m2", "assistant", "he"),
        (1, 3, "delta", "m2", "assistant", "llo"),
        (1, 4, "regenerate", "m2", "assistant", ""),
        (1, 5, "delta", "m2", "assistant", "good "),
        (1, 6, "delta", "m2", "assistant", "day"),
        (1, 7, "edit", "m1", "user", "hi there"),
        (1, 8, "message", None, "user", "bye"),
        (None, 1, "message", "m1", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, event string, message_id string, role string, text string")
    got = sorted(((r["conv_id"], r["seq"], r["role"], r["text"]) for r in chat.fold(df).collect()), key=repr)
    assert got == [(1, 1, "user", "hi there"), (1, 2, "assistant", "good day"), (1, 8, "user", "bye"), (None, 1, "", "")]
    rows = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert rows[1]["n_turns"] == 3 and rows[1]["loss_chars"] == 8 and rows[1]["loss_sha256"] == hashlib.sha256(b"good day").hexdigest()
    assert chat.formatted(df.limit(0)).count() == 0


def test_op9_on_table(spark, sf_dir):
    convs = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op9_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[k]["n_turns"], got[k]["loss_chars"]) == (len(turns), len(said))
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[k]["formatted_chars"] == len(chat.OPEN) + sum(len(chat.render(r, t)) for r, t in turns)


def test_log_folds_back(spark):
    """Every way a message may have come about gives it again; repeated rows and nulls included."""
    rows = [(c, t, random.choice(["user", "assistant", "system", None]), random.choice([None, "", "x", f"text {c} {t} é😀", "</s>[INST]"])) for c in range(30) for t in range(6)] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, event int")
    log = chat.logged(df)
    kinds = {r["event"]: r["count"] for r in log.groupBy("event").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and min(kinds.values()) > 20
    got = chat.fold(log.repartition(5)).select("conv_id", (F.col("seq") / chat.STEPS).cast("bigint"), "role", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    assert chat.logged(df.limit(0)).count() == 0


def test_messages_keep_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")] * 2, "conv_id bigint, seq bigint, role string, text string").withColumn("event", F.lit("message")).withColumn("message_id", F.lit(None).cast("string"))
    assert chat.formatted(df).first()["n_turns"] == 2
