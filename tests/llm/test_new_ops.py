"""Source divergence, turn reassembly and repeated passages against plain forms."""

import hashlib
import random

import numpy as np
import pytest
from conftest import check_oracle
from pyspark.sql import functions as F

from palimpsest.llm import divergence, passages, queries, turns

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, tag string, item string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", "z") for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_turn_reassembly", "op13_repeated_passages"])
def test_by_sql(spark, sf_dir, duck, name):
    check_oracle(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


# ---- source divergence ---------------------------------------------------------------------


def divergence_plain(rows):
    groups, docs = {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = divergence.terms_of(text)
        held = groups.setdefault((lang, source), {})
        for w in words:
            held[w] = held.get(w, 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for (lang, source), held in groups.items():
        kept = [w for (g, w), n in docs.items() if g == lang and n >= divergence.LEAST_DOCS]
        v = len(kept)
        every = {w: sum(h.get(w, 0) for (g, _), h in groups.items() if g == lang) for w in kept}

        def share(counts):
            total = sum(counts.get(w, 0) for w in kept)
            return {w: 1 + 10**9 * (counts.get(w, 0) + 2) // (total + 2 * v) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = share(held), share(every)
        pairs = [(other, sum(f(own[w], x[w]) for w in kept)) for (g, other), h in groups.items() if g == lang and other != source for x in [share(h)]]
        terms = [(w.decode(), f(own[w], whole[w])) for w in kept if held.get(w) and own[w] > whole[w]]
        for part, items, top in (("pair", pairs, None), ("term", terms, divergence.TOP)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_of_odd_rows(spark):
    random.seed(11)
    words = ["the", "The", "ÉTÉ", "été", "Σ", "x1y", "naïve-ly", "ß", "ſ", "aa"]
    rows = [(i % 50, " ".join(random.choices(words, k=random.randrange(30))), random.choice(["en", None, ""]), random.choice(["a", "b", None, "ü"])) for i in range(120)]
    rows += [(1, None, "xx", "a"), (1, "", "xx", "b"), (1, "12 3!", "xx", "c"), (None, "long " * 30_000, "en", "a"), (None, "w" * 100_000, "en", "only")]
    got = divergence.audit(docs_of(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == divergence_plain(rows)


def test_divergence_of_nothing(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0


# ---- turn reassembly -----------------------------------------------------------------------


def reassembly_plain(rows, batches=8, silent=3):
    """Batch by batch, turn by turn."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None and t is not None]
    first = {}
    for c, t, _, _ in rows:
        first[c] = min(t, first.get(c, t))
    coming = [{} for _ in range(batches)]
    for c, t, r, x in rows:
        h = int(hashlib.sha256(f"{c}:{t}".encode()).hexdigest()[:8], 16)
        for batch, role in [(h % batches, r)] + [((h + 3) % batches, "user")] * (h % 7 < 2):
            payload = (f"{role}|{x}".encode(), role)
            coming[batch][c, t] = min(payload, coming[batch].get((c, t), payload))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out, kept, seen, nxt, closed = [], {}, {}, {}, set()
    for batch in range(batches + 1):
        for (c, t), (payload, role) in coming[batch].items() if batch < batches else ():
            if c in closed:
                out.append(("reject", sha(payload), c, t, batch, None, None))
                continue
            seen[c] = batch
            nxt.setdefault(c, first[c])
            kept.setdefault(c, {}).setdefault(t, (payload, role))
        for c in seen:
            while c not in closed and nxt[c] in kept[c]:
                out.append(("release", sha(kept[c][nxt[c]][0]), c, nxt[c], batch, None, None))
                nxt[c] += 1
        for c in seen:
            if c not in closed and (batch - seen[c] >= silent or batch == batches):
                closed.add(c)
                left = ",".join(str(t) for t in sorted(kept[c]) if t >= nxt[c])
                breaks = sum(t - 1 in kept[c] and kept[c][t - 1][1] == r for t, (_, r) in kept[c].items())
                out.append(("close", sha(left.encode()), c, -1, batch, max(kept[c]) - first[c] + 1 - len(kept[c]), breaks))
    return sorted(out, key=repr)


def digested(events):
    said = F.when(F.col("event") == "close", F.col("waiting")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", F.sha2(said.cast("binary"), 256), "conv_id", "turn", "batch", "n_missing", "n_breaks")


def test_reassembly_by_brute_force(spark):
    random.seed(12)
    rows = [(c, t, random.choice(["user", "assistant", "a|b", None]), random.choice(["x", "é", None, "", "|", "long " * 2_000])) for c in range(60) for t in range(random.randrange(-3, 2), random.randrange(2, 30)) if random.random() < 0.8]
    rows += random.choices(rows, k=80) + [(None, 1, "user", "x"), (3, None, "user", "x"), ((1 << 60) + 1, 0, "user", "a"), ((1 << 60) + 2, 0, "user", "b"), (-5, 7, "user", "c")]
    rows += [(99, t, "user", f"t{t}") for t in range(3_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("batch", F.lit("clash")).withColumn("first", F.lit(0))
    got = sorted((tuple(r) for r in digested(turns.replayed(spark, frame)).collect()), key=repr)
    want = reassembly_plain(rows)
    assert got == want and {r[0] for r in want} == {"release", "reject", "close"}


def test_reassembly_of_nothing(spark):
    assert turns.replayed(spark, spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_bucket_state_keeps_only_what_waits():
    empty = lambda schema: turns._thawed(None, schema)
    b = turns.Bucket(empty(turns._CONVS), empty(turns._WAITING))
    col = lambda *v: np.array(v, object)
    ids = lambda *v: np.array(v, np.int64)
    out = b.take(0, ids(1, 1, 2), ids(0, 2, 5), col("u", "u", "a"), col("x", "y", "z"), ids(0, 0, 4))
    assert out[1]["turn"].tolist() == [0] and b.waiting["turn"].tolist() == [2, 5]
    out = b.take(1, ids(1, 1), ids(1, 2), col("u", "other"), col("w", "late"), ids(0, 0))
    assert out[1]["text"].tolist() == ["w", "y"] and b.waiting["turn"].tolist() == [5]
    closed = b.close(np.array([0, 1]))
    assert closed["n_breaks"].tolist() == [2, 0] and closed["n_missing"].tolist() == [0, 1] and closed["waiting"].tolist() == ["", "5"]
    again = turns._thawed(turns._frozen(b.convs, turns._CONVS), turns._CONVS)
    assert again["closed"].all() and not len(b.waiting["turn"])


# ---- repeated passages ---------------------------------------------------------------------


def passages_plain(rows):
    split = [(i, passages.words_of(t)) for i, t in rows]
    least = {}
    for i, w in split:
        for at in range(len(w) - 12):
            k = tuple(w[at : at + 13])
            if i is not None:
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        for at in range(len(w) - 12):
            if i is not None and least[tuple(w[at : at + 13])] < i:
                gone |= set(range(at, at + 13))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out, key=repr)


def passage_rows():
    random.seed(13)
    vocab = [f"w{i}" for i in range(400)]
    draw = lambda n: random.choices(vocab, k=n)
    shared, two = draw(60), draw(14)
    rows = [(i, " ".join(draw(40) + shared[: random.randrange(10, 61)] + draw(30) + two)) for i in range(60)]
    rows += [(i, " ".join(["same"] * random.randrange(10, 60))) for i in range(100, 140)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (200, rows[1][1]), (200, rows[1][1]), (7, rows[3][1]), (-4, rows[5][1])]
    rows += [(300, None), (301, ""), (302, "a  b\tc"), (None, rows[2][1]), (303, "é x " * 14), (304, "é x " * 20), (305, "\x00 " * 30)]
    return rows + [(400, " ".join(draw(30_000))), (401, " ".join(["same"] * 30_000)), (402, "x" * 200_000)]


@pytest.mark.parametrize("hold, parts", [(200_000, "4"), (10, "4"), (10, "64")])
def test_passages_by_brute_force(spark, monkeypatch, hold, parts):
    """With a small hold, buckets are put off to the windows' own way, by the count before or by the task."""
    rows = passage_rows()
    monkeypatch.setattr(passages, "HOLD", hold)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = passages.cleaned(docs_of(spark, [(i, t, "en", "s") for i, t in rows]))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == passages_plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passages_of_nothing(spark):
    assert passages.cleaned(docs_of(spark, [])).count() == 0


def test_super_kmers_cover_each_window_once():
    random.seed(5)
    for n in (0, 12, 13, 14, 60, 500):
        words = [random.choice([b"a", b"b", b"cc"]) for _ in range(n)]
        _, first, last = passages.super_kmers(words)
        assert [i for s, e in zip(first, last) for i in range(s, e + 1)] == list(range(max(0, n - 12)))
        assert all(e - s <= 10 for s, e in zip(first, last))
    a, b = ([b"w%d" % i for i in x] for x in (range(40), range(20, 60)))
    where = lambda words: {tuple(words[i : i + 13]): k for k, s, e in zip(*passages.super_kmers(words)) for i in range(s, e + 1)}
    one, two = where(a), where(b)
    assert one.keys() & two.keys() and all(one[w] == two[w] for w in one.keys() & two.keys())
