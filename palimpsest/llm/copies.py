"""Near copies for the pipeline: texts whose five-word shingles agree to 0.8 or more.

One pass over the texts gives each its SimHash fingerprint and a MinHash sketch of its five-word
shingles. Both only name pairs to look at: the Gray-order index of ``simhash`` links fingerprints within 4
bits, and texts that share a band of their sketches are looked at as well (most texts that agree to 0.8
stand further apart than any such index can reach, 9.7 bits on average). Whether two texts are alike
is decided on their sets of shingles (as 64-bit hashes), for every link.

Bands: 32 of 4 hashes; two texts at 0.8 share none with probability (1 - 0.8 ** 4) ** 32 = 5e-8, above
0.8 with less. Work is done in two steps. In the first every text meets one centre of each of its
buckets and of its group of fingerprints; that is linear, and joins most groups of copies. In the
second, buckets whose texts are not all together yet are compared in tiles, by sketches alone; only texts
that have a near one of another group get their sets sent to a tile, which gives back links that span
what it found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, free, lookup, materialise, remove, small
from .graph import components
from .simhash import majority, rooted, shingle_hashes, words_of

#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 32, 4
#: Sketches hold 4 bits of each hash. At 0.8 two of them differ in 51 bits on average, deviation 10.4; at
#: more than this (five deviations, similarity 0.6 on average) a pair is put aside.
DIFFER = 103
#: Places of sets that are sent to the texts by broadcast at most (some 120 bytes each, so about 60 MB).
PLACES = 500_000
#: Members of a bucket that one task compares; a larger one is cut into tiles that meet in pairs.
TILE = 1_024

_RNG = np.random.default_rng(20_11)
_TIMES = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_BAND = _RNG.integers(0, 1 << 63, BANDS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def five_words(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles from those of the four-word shingles in order: two that follow one
    another make one. Of a text under five words, of the whole sequence."""
    return _mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(hashes[1:])) if len(hashes) > 1 else _mix(hashes)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands and 512 bits of the MinHashes, from the hashes of the five-word shingles."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFF_FFFF, np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, (short[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    wide = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _mix(_mix(wide[:, 0] | wide[:, 1] << np.uint64(32)) + (wide[:, 2] | wide[:, 3] << np.uint64(32)) + _BAND)
    bits = (least * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    return keys.view(np.int64), (bits[::2] | bits[1::2] << np.uint8(4)).view(np.int64)


def digest(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, digest, keys, bits)`` of each row: fingerprint, a name of its sequence of words, sketch.
    A text without words has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, names, keys, bits, sizes = [], [], [], [], [0]
            for text in b.column(1).to_pylist():
                words = words_of(text)
                hashes = shingle_hashes(words)
                fps.append(majority(hashes))
                names.append(digest(words))
                if words:
                    k, v = sketch(five_words(hashes))
                    keys.append(k)
                    bits.append(v)
                sizes.append(len(keys))
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32) * np.int32(m)), flat(x)) for m, x in ((BANDS, keys), (8, bits))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(names, pa.int64()), *lists], names=["id", "fp", "digest", "keys", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint, digest bigint, keys array<bigint>, bits array<bigint>")


def _sent(work: Work, docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places(id, digest, ...)`` with the ``shingles`` of the text that has this id and name, its sorted distinct
    hashes: the names go to the texts, and a set is made where its text is, once, and sent to each of its places."""
    columns = [c for c in places.columns if c not in ("id", "digest")]
    to = work.table(places.groupBy("id", "digest").agg(F.collect_list(F.struct(*columns)).alias("places")), "places")
    if (to.agg(F.sum(F.size("places"))).first()[0] or 0) <= PLACES:
        to = small(to)
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(to, "id").select("text", "digest", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                words = [words_of(t) for t in b.column(0).to_pylist()]
                made = [np.unique(five_words(shingle_hashes(w))).tobytes() if digest(w) == d else None for w, d in zip(words, b.column(1).to_pylist())]
                sets = pa.array(made, pa.binary()).take(b.column(2).value_parent_indices())
                out = pa.RecordBatch.from_arrays([*b.column(2).flatten().flatten(), sets], names=[*columns, "shingles"])
                yield out.filter(sets.is_valid())

    kinds = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in columns)
    return asked.mapInArrow(run, f"{kinds}, shingles binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Two sorted sets of hashes, at 0.8 or more."""
    most = min(len(a), len(b))
    if (OVER + UNDER) * most < OVER * (len(a) + len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    return (OVER + UNDER) * int((both[1:] == both[:-1]).sum()) >= OVER * (len(a) + len(b)) > 0


def spanning(comps: list[int], bits: np.ndarray, sets: list[np.ndarray], split: int | None = None) -> list[tuple[int, int]]:
    """Links between components such that members alike end up together. With ``split``, members before it
    meet only those behind it."""
    up = {c: c for c in comps}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i in range(len(comps) if split is None else split):
        first = i + 1 if split is None else split
        near = np.flatnonzero(np.bitwise_count(bits[first:] ^ bits[i]).sum(axis=1) <= DIFFER)
        for j in (near + first).tolist():
            u, v = find(comps[i]), find(comps[j])
            if u != v and alike(sets[i], sets[j]):
                up[max(u, v)] = min(u, v)
                out.append((comps[i], comps[j]))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles arrive sorted by (key, t1, t2, t); each is worked on when its last row has come."""
    held_key, held = None, []

    def flush() -> pa.RecordBatch:
        sides, comps = [r[0] for r in held], [r[1] for r in held]
        bits, sets = np.array([r[2] for r in held], np.uint64), [np.frombuffer(r[3], np.uint64) for r in held]
        links = spanning(comps, bits, sets, sides.index(held_key[2]) if held_key[1] != held_key[2] and held_key[2] in sides else None)
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["u", "v"])

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(7)]
        bits = b.column(5).values.to_numpy().view(np.uint64).reshape(-1, 8) if b.num_rows else []
        for n, (key, t1, t2, t, comp, _, data) in enumerate(zip(*cols)):
            if (key, t1, t2) != held_key:
                if len(held) > 1:
                    yield flush()
                held_key, held = (key, t1, t2), []
            held.append((t, comp, bits[n], data))
    if len(held) > 1:
        yield flush()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tiles that arrive sorted by (key, t1, t2, t), the rows with a near sketch in another component."""
    held_key, held = None, []

    def flush() -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks()
        side, comp = rows.column("t").to_numpy(), rows.column("comp").to_numpy()
        bits = rows.column("bits").combine_chunks().values.to_numpy().view(np.uint64).reshape(-1, 8)
        split = int(np.searchsorted(side, held_key[2])) if held_key[1] != held_key[2] else None
        near = np.zeros(len(comp), bool)
        for i in range(len(comp) if split is None else split):
            first = i + 1 if split is None else split
            found = (np.bitwise_count(bits[first:] ^ bits[i]).sum(axis=1) <= DIFFER) & (comp[first:] != comp[i])
            near[first:] |= found
            near[i] |= found.any()
        return rows.filter(pa.array(near)).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            key = tuple(k[:, lo].tolist())
            if key != held_key:
                if held:
                    yield from flush()
                held_key, held = key, []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from flush()


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, salt, member): the centre's set comes first, the others are held against it."""
    at, own = None, None
    for b in batches:
        u, v = [], []
        for centre, salt, member, name, data in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (centre, salt) != at:
                at, own = (centre, salt), None
            if not member:
                own = np.frombuffer(data, np.uint64)
            elif own is not None and alike(own, np.frombuffer(data, np.uint64)):
                u.append(centre)
                v.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _centred(work: Work, texts: DataFrame, roots: DataFrame, live: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(u, v)``: texts that are alike to a centre of their fingerprints' group or of one of their buckets.
    ``roots(digest, root, fp)``: the group of each text's fingerprint."""
    total = texts.count()
    group = roots.groupBy("root").agg(F.min(F.when(F.col("fp") == F.col("root"), F.col("digest"))).alias("centre"), F.count("*").alias("n")).filter("n > 1")
    by_fp = lookup(roots.select("root", "digest"), work.table(group, "groups"), "root", "n", total)
    by_band = lookup(texts.select(F.explode("keys").alias("key"), "digest"), live.select("key", F.col("lo").alias("centre"), "n"), "key", "n", BANDS * total)
    pairs = by_fp.select("digest", "centre").unionByName(by_band.select("digest", "centre")).filter("digest <> centre").distinct()
    pairs = work.table(pairs, "pairs")
    size = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    centres = work.table(size.join(texts.select(F.col("digest").alias("centre"), F.col("bits").alias("its")), "centre"), "centres")
    both = lookup(pairs, centres, "centre", "n", pairs.count()).join(texts.select("id", "digest", "bits"), "digest")
    differ = F.aggregate(F.zip_with("bits", "its", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = work.table(both.filter(differ <= DIFFER).select("centre", "digest", "id"), "near")
    parts = near.groupBy("centre").agg(F.count("*").alias("n"), F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    parts = work.table(parts, "parts")
    heads = parts.join(texts.select("id", F.col("digest").alias("centre")), "centre").select("id", F.col("centre").alias("digest"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("centre").alias("name"))
    members = lookup(near, parts, "centre", "n", near.count()).select("id", "digest", "centre", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("digest").alias("name"))
    rows = _sent(work, docs, heads.unionByName(members), id_col, text_col).withColumn("h", F.hash("centre", "salt"))
    return rows.repartition("h").sortWithinPartitions("centre", "salt", "member").drop("h").mapInArrow(_starred, "u bigint, v bigint")


def _tiled(work: Work, texts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(u, v)``: links between the components of texts that share a bucket, in ``texts(id, digest, comp, keys, bits)``."""
    live = texts.select(F.explode("keys").alias("key"), "comp").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    live = work.table(live.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("parts"), "n"), "live")
    met = lookup(texts.select(F.explode("keys").alias("key"), "digest"), live, "key", "n", BANDS * texts.count())
    met = work.table(met, "met").join(texts.select("id", "digest", "comp", "bits"), "digest")
    tile = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    met = met.select("key", "id", "digest", "comp", "bits", tile.alias("t"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("h", F.hash("key", "t1", "t2")).repartition("h").sortWithinPartitions("key", "t1", "t2", "t").drop("h")

    tiles = met.select("key", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "t", "comp", "bits", "id", "digest")
    close = work.table(dealt(tiles).mapInArrow(_close, tiles.schema), "close")
    return dealt(_sent(work, docs, close, id_col, text_col)).mapInArrow(_linked, "u bigint, v bigint")


def rooted_copies(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` of ``sketches`` -> ``(digest, comp, n)``: for each text the component that links of 0.8 make, named
    by one of its texts, and the number of its rows, as a written table."""
    work = Work()
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "fp", "keys", "bits")).alias("x"), F.count("*").alias("n"))
    every = work.table(first.select("digest", "x.*", "n"), "every")
    texts = every.filter("size(keys) > 0")
    found = rooted(rows.select("id", "fp"))
    work.tables.append(found)
    roots = work.table(lookup(texts.select("digest", "fp"), found.select("fp", "root", "n"), "fp", "n", rows.count()), "roots")
    live = texts.select(F.explode("keys").alias("key"), "digest").groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("n")).filter("lo < hi").drop("hi")
    links = work.table(_centred(work, texts, roots, work.table(live, "live"), docs, id_col, text_col), "links")
    stars = components(links)
    work.tables.append(stars)
    grouped = texts.join(stars.withColumnRenamed("node", "digest"), "digest", "left").select("id", "digest", F.coalesce("root", "digest").alias("comp"), "keys", "bits")
    more = work.table(_tiled(work, work.table(grouped, "grouped"), docs, id_col, text_col), "more")
    last = components(links.unionByName(more))
    work.tables.append(last)
    out = every.select("digest", "n").join(last.withColumnRenamed("node", "digest"), "digest", "left")
    out = materialise(out.select("digest", F.coalesce("root", "digest").alias("comp"), "n"), "components")
    work.clear()
    return out


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies the row with the least id; all columns are kept.

    Texts are linked by five-word shingles of similarity 0.8 or more, each link verified. Rows are told
    apart by id and words, so of an id that stands at several texts each text has its own fate; equal rows
    become one. Rows without an id are kept and link nothing. Null texts and texts without words are copies
    of each other; an empty table stays empty."""
    work = Work()
    rows = work.table(sketches(docs.filter(F.col(id_col).isNotNull()), id_col, text_col), "sketches")
    comps = rooted_copies(rows, docs, id_col, text_col)
    own = work.table(lookup(rows.select("id", "digest"), comps, "digest", "n", rows.count()), "own")
    stay = own.groupBy("comp").agg(F.min(F.struct("id", "digest")).alias("k")).select("k.id", "k.digest")
    # An id of one row is settled by the id; texts of repeated ids are named once more.
    again_id, gone_id, its_id, its_name = (free(docs, x) for x in ("__again", "__gone", "__id", "__name"))
    again = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias(again_id)), "again")
    kept = materialise(stay.select(F.col("id").alias(its_id), F.col("digest").alias(its_name)).join(again, F.col(its_id) == F.col(again_id), "left_semi"), "kept")
    own = own.select("id", "digest").distinct()
    gone = materialise(own.join(stay, ["id", "digest"], "left_anti").select(F.col("id").alias(gone_id)).distinct(), "gone")
    work.clear()
    remove(comps)
    key = F.col(id_col)
    once = docs.filter(key.isNotNull()).join(small(again), key == F.col(again_id), "left_anti").join(small(gone), key == F.col(gone_id), "left_anti")

    def named(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest(words_of(t)))

    made = free(docs, "__digest")
    twice = docs.join(small(again), key == F.col(again_id), "left_semi").withColumn(made, F.pandas_udf(named, "bigint")(F.coalesce(F.col(text_col), F.lit(""))))
    twice = twice.join(kept, (key == F.col(its_id)) & (F.col(made) == F.col(its_name)), "left_semi").dropDuplicates([id_col, made]).select(*docs.columns)
    return once.unionByName(twice).unionByName(docs.filter(key.isNull()))
