"""Substring dedup: words of passages that also stand in a document with a smaller id are cut.

A window is 13 consecutive words. Consecutive windows that share a minimiser (the least hash of their
three-word runs) travel as one string of at most 23 words, a super-k-mer, to the bucket of that
minimiser: equal windows have equal minimisers, so they meet there. In a bucket the windows are
sorted; the first of equal ones names the least document, word for word, not by hash.

Super-k-mers are packed: a task gathers those of one reducer into columns and sends them as one
compressed block. Spark sorts the unpacked rows by bucket, on disk if need be.

A bucket that holds more than a fair share of all super-k-mers (a passage that very many documents
share) would go to one task. Such buckets are found first, by counts that every task sends only of
what is frequent in its own part: of a bucket with the share s of all, parts in which its share is
below s/2 hold less than half, so none is missed, and there are few. Their super-k-mers are
aggregated as strings before they are shuffled, so copies count once; the windows of the distinct
strings find their owners, and the strings take them back to the documents. The same is done with a
bucket that is too large for a task to hold. Both ways give the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lookup, materialise

#: Words of a window, and of the runs whose hashes compete to be its minimiser.
WINDOW, RUN = 13, 3
#: A task holds so many super-k-mers of a bucket, and packs so many bytes at a time.
HOLD, PACK = 200_000, 32 << 20
#: Cut places that are broadcast at most.
CUTS = 1_000_000
_PLACE = 20


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but blanks, tabs and line ends; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def super_kmers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, first, last)``: windows first to last, by their first words, have the minimiser of the bucket."""
    import xxhash

    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    runs = h[: n - RUN + 1].copy()
    for i in range(1, RUN):
        runs = _mix(runs) + h[i : n - RUN + 1 + i]
    low = np.uint64((1 << _PLACE) - 1)
    # The place in the low bits makes each occurrence its own, so no string gets longer than two windows.
    at = (_mix(runs) & ~low) | (np.arange(len(runs), dtype=np.uint64) & low)
    wide, width = at, 1
    while width < WINDOW - RUN + 1:
        step = min(width, WINDOW - RUN + 1 - width)
        wide = np.minimum(wide[: len(wide) - step], wide[step:])
        width += step
    first = np.flatnonzero(np.concatenate(([True], wide[1:] != wide[:-1])))
    last = np.concatenate((first[1:], [len(wide)])) - 1
    return (wide[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), first, last


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, tag, text)``: the tag tells rows of one id apart, in the high half of a word's place."""
    tag = F.shiftleft(F.xxhash64(F.col(text_col)), 32)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))


def frequent(rows: DataFrame, parts: int) -> list[int]:
    """Buckets with more than a fair share of the super-k-mers and more than a task holds: under 2 * parts."""
    share = 1 / (2 * parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= share * n
            return pa.RecordBatch.from_arrays([pa.array([*names[often].tolist(), None], pa.int32()), pa.array([*counts[often].tolist(), n], pa.int64())], names=["bucket", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                bucket, _, _ = super_kmers(words_of(text))
                held.append(bucket)
                n += len(bucket)
                if n > 1_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    counts = materialise(rows.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")), "often")
    total = counts.filter("bucket IS NULL").agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.filter(F.col("bucket").isNotNull() & (F.col("n") > max(HOLD, share * total))).collect()]


def _packed(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b" ".join(words), np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))


def dealt(rows: DataFrame, parts: int, hot: list[int]) -> DataFrame:
    """``(part, n, size, block)``: super-k-mers of buckets that are not hot, in compressed blocks by reducer."""
    skip = np.array(sorted(hot), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bucket, ids, place, length = (np.concatenate([h[i] for h in held]) for i in range(4))
            strings = [s for h in held for s in h[4]]
            part = bucket.view(np.uint32) % np.uint32(parts)
            order = np.argsort(part, kind="stable")
            names, starts = np.unique(part[order], return_index=True)
            out = []
            for name, own in zip(names.tolist(), np.split(order, starts[1:])):
                raw = b"".join([*(x[own].tobytes() for x in (bucket, ids, place, length)), *map(strings.__getitem__, own.tolist())])
                out.append((name, len(own), len(raw), codec.compress(raw, asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "n", "size", "block"])

        for b in batches:
            for key, tag, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                bucket, first, last = super_kmers(words)
                if len(skip):
                    cold = ~np.isin(bucket, skip)
                    bucket, first, last = bucket[cold], first[cold], last[cold]
                if not len(bucket):
                    continue
                joined, at = _packed(words)
                begin, end = at[first], at[last + WINDOW] - 1
                held.append((bucket, np.full(len(bucket), key, np.int64), first + tag, (end - begin).astype(np.int32), [joined[s:e] for s, e in zip(begin.tolist(), end.tolist())]))
                size += int((end - begin).sum()) + 24 * len(bucket)
                if size > PACK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "part int, n int, size bigint, block binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for b in batches:
        for n, size, block in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            raw = codec.decompress(block, size)
            bucket, ids, place, length = pa.py_buffer(raw)[: 4 * n], pa.py_buffer(raw)[4 * n : 12 * n], pa.py_buffer(raw)[12 * n : 20 * n], np.frombuffer(raw, np.int32, n, 20 * n)
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
            strings = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)[24 * n :]]).cast(pa.binary())
            columns = [pa.Array.from_buffers(t, n, [None, x]) for t, x in ((pa.int32(), bucket), (pa.int64(), ids), (pa.int64(), place))]
            whole = pa.RecordBatch.from_arrays([*columns, strings], names=["bucket", "id", "place", "string"])
            for i in range(0, n, 10_000):
                yield whole.slice(i, 10_000)


def windows(string: bytes) -> list[bytes]:
    """All windows of a super-k-mer."""
    words = string.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def repeated(ids: list[int], strings: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """``(row, first, last)``: windows first to last of a row of one bucket that a smaller id has as well."""
    least: dict[bytes, int] = {}
    for i, s in zip(ids, strings):
        if i < least.get(s, i + 1):
            least[s] = i
    sorts = sorted((w, i) for s, i in least.items() for w in windows(s))
    owner: dict[bytes, int] = {}
    for w, i in sorts:
        owner.setdefault(w, i)
    owners = {s: [owner[w] for w in windows(s)] for s in least}
    for row, (i, s) in enumerate(zip(ids, strings)):
        first = None
        for at, o in enumerate(owners[s]):
            if o < i and first is None:
                first = at
            elif o >= i and first is not None:
                yield row, first, at - 1
                first = None
        if first is not None:
            yield row, first, len(owners[s]) - 1


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket -> ``(id, place, last, string)``: a span of repeated words, or, of a bucket
    that is too large to hold, a super-k-mer to be looked up."""
    held: pa.Table | None = None
    beyond: int | None = None

    def told(ids: list, places: list, lasts: list, names: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(lasts, pa.int32()), pa.array(names, pa.binary())], names=["id", "place", "last", "string"])

    def put_off(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in table.to_batches(max_chunksize=10_000):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.nulls(b.num_rows, pa.int32()), b.column(3)], names=["id", "place", "last", "string"])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
        if not len(bucket):
            return
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(bucket))
        shared = np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)
        out: list[tuple] = []
        for s, e in zip(starts[shared].tolist(), ends[shared].tolist()):
            own, place = ids[s:e].tolist(), table.column(2).slice(s, e - s).to_pylist()
            for row, first, last in repeated(own, table.column(3).slice(s, e - s).to_pylist()):
                out.append((own[row], place[row] + first, last - first + WINDOW, None))
        if out:
            yield told(*zip(*out))

    for b in batches:
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        bucket = table.column(0).to_numpy()
        if not len(bucket):
            continue
        if beyond is not None:
            n = int(np.searchsorted(bucket, beyond, "right"))
            yield from put_off(table.slice(0, n))
            table, bucket = table.slice(n), bucket[n:]
            if not len(bucket):
                held = None
                continue
            beyond = None
        n = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on
        yield from settle(table.slice(0, n).combine_chunks())
        held = table.slice(n).combine_chunks()
        if held.num_rows > HOLD:
            yield from put_off(held)
            held, beyond = None, int(bucket[-1])
    if held is not None and held.num_rows:
        yield from settle(held)


def _strings_of(rows: DataFrame, hot: list[int]) -> DataFrame:
    """``(id, place, string)`` of all super-k-mers in hot buckets."""
    wanted = np.array(sorted(hot), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, tag, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                bucket, first, last = super_kmers(words)
                own = np.isin(bucket, wanted)
                if own.any():
                    joined, at = _packed(words)
                    names = [joined[s:e] for s, e in zip(at[first[own]].tolist(), (at[last[own] + WINDOW] - 1).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), key, np.int64)), pa.array(first[own] + tag), pa.array(names, pa.binary())], names=["id", "place", "string"])

    return rows.mapInArrow(run, "id bigint, place bigint, string binary")


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows = [(s, k, w, i) for s, i in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, w in enumerate(windows(s))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary(), pa.int64()))], names=["string", "k", "window", "id"])


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of each row that a smaller id owns; those that follow one another make one."""
    for b in batches:
        out = []
        for i, place, owners in zip(*(b.column(c).to_pylist() for c in range(3))):
            gone = np.concatenate(([0], np.fromiter((o < i for o in owners), np.int8, len(owners)), [0]))
            edge = np.flatnonzero(np.diff(gone))
            out += [(i, place + s, e - 1 - s + WINDOW) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
        columns = zip(*out) if out else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=["id", "place", "last"])


def _looked_up(apart: DataFrame) -> DataFrame:
    """``apart(id, place, string)`` as a written table -> ``(id, place, last)``: spans of repeated words."""
    strings = materialise(apart.groupBy("string").agg(F.min("id").alias("id"), F.count("*").alias("n")), "strings")
    each = materialise(strings.select("string", "id").mapInArrow(_taken_apart, "string binary, k int, window binary, id bigint"), "each")
    owner = materialise(each.groupBy("window").agg(F.min("id").alias("owner"), F.count("*").alias("n")), "owner")
    known = lookup(each.select("string", "k", "window"), owner, "window", "n", each.count())
    listed = known.groupBy("string").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "owner"))), lambda x: x["owner"]).alias("owners"))
    table = materialise(listed.join(strings.select("string", "n"), "string"), "owned")
    return lookup(apart, table, "string", "n", apart.count()).select("id", "place", "owners").mapInArrow(_owned, "id bigint, place bigint, last int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row in order, those that touch made one, as a flat list of begins and ends."""
    for b in batches:
        out = []
        for spans in b.column(2).to_pylist():
            pairs = np.array([(s["begin"], s["end"]) for s in spans], np.int64)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            upto = np.maximum.accumulate(pairs[:, 1])
            new = np.concatenate(([True], pairs[1:, 0] > upto[:-1]))
            ends = upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)]
            out.append(np.stack((pairs[new, 0], ends), 1).ravel().tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["id", "tag", "cuts"])


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tag, cuts)``: the word spans to be cut from each row that has any, as a written table."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _documents(docs, id_col, text_col).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    hot = frequent(rows, parts)
    blocks = dealt(rows, parts, hot).repartitionById(parts, F.col("part"))
    strings = blocks.mapInArrow(_unpacked, "bucket int, id bigint, place bigint, string binary").sortWithinPartitions("bucket")
    found = materialise(strings.mapInArrow(_found, "id bigint, place bigint, last int, string binary"), "found")
    spans = found.filter("string IS NULL").select("id", "place", "last")
    apart = found.filter("string IS NOT NULL").select("id", "place", "string")
    if hot or apart.limit(1).count():
        spans = spans.unionByName(_looked_up(materialise(apart.unionByName(_strings_of(rows, hot)) if hot else apart, "apart")))
    low = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    span = F.struct(low.alias("begin"), (low + F.col("last")).alias("end"))
    listed = spans.groupBy("id", (F.col("place") - low).alias("tag")).agg(F.collect_list(span).alias("spans"))
    return materialise(listed.mapInArrow(_merged, "id bigint, tag bigint, cuts array<bigint>"), "cuts")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row: its words but those in windows of 13 words that a row
    with a smaller id has as well, joined by blanks. Windows are judged on the input.

    Null and empty texts have no words; shorter texts have no windows. Rows of one id are each other's
    neither, so copies under one id all stay; a row without an id loses nothing and costs others nothing. An
    empty table stays empty. Other columns are not looked at."""
    made = cuts(docs, id_col, text_col)
    n, held = made.agg(F.count("*"), F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and held <= CUTS:
        made = F.broadcast(made)
    rows = _documents(docs, id_col, text_col).join(made, ["id", "tag"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, kept = [], [], []
            for text, spans in zip(*(b.column(i).to_pylist() for i in (1, 2))):
                words = words_of(text)
                sizes.append(len(words))
                stay, at = [], 0
                for s, e in zip((spans or [])[::2], (spans or [])[1::2]):
                    stay += words[at:s]
                    at = e
                stay += words[at:]
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "cuts").mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")


def op13_sql() -> str:
    """Every window of every text against all others."""
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, x.i AS i, x.k AS k FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 2}, 1)), lambda i: {{'i': i, 'k': array_to_string(w[i:i + {WINDOW - 1}], ' ')}})) AS x FROM d)),
    hit AS (SELECT win.doc_id, win.i FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k) o ON win.k = o.k WHERE o.least < win.doc_id),
    gone AS (SELECT DISTINCT doc_id, i + o AS i FROM hit CROSS JOIN (SELECT unnest(range({WINDOW})) AS o)),
    word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
    kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS kept, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
