"""Training-order materialisation: token ids as fixed-stride binary shards in permuted order.

Documents are strung together within each scan split, each closed by an end mark, and cut into
sequences of equal length. Splits get consecutive index ranges, so every sequence has a dense
global index without any shuffle; a keyed Feistel network with cycle-walking turns it into its
slot. Sequences go to their shard by range of slots, are sorted there and written as records of
one fixed size, so a reader seeks to slot * stride and goes on from wherever it stopped.

Ids are those of a column of integer arrays, stored in 2 or 4 bytes, or else the UTF-8 bytes of a
text: ids 0 to 253 (UTF-8 uses none above 244), 254 pads, 255 ends a document. Every record is the
sequence's index, its count of ids and their CRC-32, then the ids, then a line feed, which is the
terminator of Spark's text writer: shards go through its commit protocol, so a lost executor
leaves no half-written or doubled shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, work_path

LENGTH = 2048
SHARD_ROWS = 16_384
KEY = 0x5EED_0F_7A1E
ROUNDS = 6
PAD, END = 254, 255
HEAD, HEAD_SIZE = "<QII", 16


def stride(length: int = LENGTH, width: int = 1) -> int:
    return HEAD_SIZE + length * width + 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & 0xFFFF_FFFF_FFFF_FFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of 0..n-1: a balanced Feistel network over the least even power of two that
    holds n; values that fall outside are walked on until they return."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(_mix(np.array([key + 0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1], np.uint64), 0)[0]) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> h, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << h) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _bare(docs: DataFrame) -> bool:
    """Whether ``docs`` is one scan of files with deterministic filters and projections and nothing else:
    then each split is read whole, by one task, the same way each time."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        if not plan.deterministic():
            return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and bool(docs.inputFiles())


def write(docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, ids_col: str | None = None, width: int = 2, pad: int = 0, end: int = 0) -> dict:
    """Write all texts of ``docs`` under ``path``; returns the manifest that is also written there.

    With ``ids_col``, an array of integers, its ids are written in ``width`` (2 or 4) bytes each, documents
    closed by ``end`` and the last sequence of a split filled with ``pad``; else the bytes of ``text_col``.
    ``docs`` is a bare scan of files, or else is written down first: index ranges hang on the splits. Null
    texts or arrays count as empty; an empty document is its end mark; repeated rows are written each
    time; other columns are ignored; an empty table writes no shard. An id that does not fit fails.

    One row a scan split, of four numbers, reaches the driver, which holds every split of a scan anyway.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(ids_col or text_col).alias("payload"))
    if not _bare(docs):
        docs = materialise(docs, "sequenced")
    if ids_col is None:
        width, pad, end = 1, PAD, END
        payload, size = F.coalesce(F.col("payload"), F.lit("")), F.octet_length("payload")
    else:
        payload, size = F.coalesce(F.col("payload"), F.array()), F.greatest(F.size("payload"), F.lit(0))
    kind = {1: np.dtype("u1"), 2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
    place = [F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("block")]
    sizes = docs.select(*place, F.coalesce(size, F.lit(0)).cast("bigint").alias("size")).groupBy("file", "block").agg((F.sum("size") + F.count("*")).alias("size")).toArrow()
    sizes = sizes.sort_by([("file", "ascending"), ("block", "ascending")]).to_pydict()
    counts = [-(-s // length) for s in sizes["size"]]
    n = sum(counts)
    starts = spark.sparkContext.broadcast(dict(zip(zip(sizes["file"], sizes["block"]), np.cumsum([0, *counts]).tolist())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index, buffer, done = None, 0, bytearray(), set()
        step, mark = length * width, np.array([end], kind).tobytes()

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal index
            count = -(-len(buffer) // step) if last else len(buffer) // step
            if not count:
                return
            at = np.arange(index, index + count)
            records = []
            for i in range(count):
                ids = bytes(buffer[i * step : (i + 1) * step])
                records.append(struct.pack(HEAD, index + i, len(ids) // width, zlib.crc32(ids)) + ids + np.full((step - len(ids)) // width, pad, kind).tobytes())
            del buffer[: count * step]
            index += count
            yield pa.RecordBatch.from_arrays([pa.array(permute(at, n, key)), pa.array(records, pa.binary())], names=["slot", "record"])

        def coded(x) -> bytes:
            if width == 1:
                return x.encode("utf-8")
            ids = np.array(x, np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >> 8 * width):
                raise ValueError(f"an id does not fit into {width} bytes")
            return ids.astype(kind).tobytes()

        for b in batches:
            for f, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (f, k) != place:
                    if place is not None:
                        yield from cut(True)
                        done.add(place)
                    if (f, k) in done:
                        raise RuntimeError("a scan split came in pieces")
                    place, index = (f, k), starts.value[f, k]
                buffer += coded(t)
                buffer += mark
                if len(buffer) >= step * 256:
                    yield from cut(False)
            yield from cut(False)
        yield from cut(True)

    shards = -(-n // shard_rows)
    manifest = {"sequences": n, "length": length, "width": width, "shard_rows": shard_rows, "shards": shards, "stride": stride(length, width), "key": key, "pad": pad, "end": end}
    if n:
        records = docs.select(*place, payload.alias("payload")).mapInArrow(pack, "slot bigint, record binary").withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
        dealt = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
        dealt.select(F.col("record").cast("string").alias("value")).write.text(f"{path}/shards")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read(spark: SparkSession, path: str, start: int = 0, count: int | None = None) -> DataFrame:
    """Records from slot ``start`` on: ``(slot, shard, byte_offset, sequence, n_tokens, crc32, ids, sound)``.

    Only the shards that hold the wanted slots are opened; Spark reads each of them, of bounded size, as
    a whole, a reader with its own file access goes to slot * stride at once. ``ids`` are the bytes of the
    ids, in the manifest's width. ``sound``: the record's CRC fits its ids and
    its slot is the permutation of its sequence number."""
    m = manifest_of(spark, path)
    n, rows, key, step, width = m["sequences"], m["shard_rows"], m["key"], m["stride"], m["width"]
    schema = "slot bigint, shard int, byte_offset bigint, sequence bigint, n_tokens bigint, crc32 bigint, ids binary, sound boolean"
    stop = n if count is None else min(n, start + count)
    if start >= stop:
        return spark.createDataFrame([], schema)
    wanted = "{" + ",".join(f"part-{s:05d}*" for s in range(start // rows, (stop - 1) // rows + 1)) + "}" if start >= rows or stop < n else "part-*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).load(f"{path}/shards").select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, step)
                for lo in range(0, len(data), 1024):
                    part = data[lo : lo + 1024]
                    slot = shard * rows + np.arange(lo, lo + len(part))
                    index = part[:, :8].copy().view("<u8")[:, 0]
                    size, crc = part[:, 8:12].copy().view("<u4")[:, 0], part[:, 12:16].copy().view("<u4")[:, 0]
                    ids = [part[i, HEAD_SIZE : HEAD_SIZE + s * width].tobytes() for i, s in enumerate(size.tolist())]
                    sound = (permute(index, n, key) == slot) & (np.array([zlib.crc32(x) for x in ids], np.uint32) == crc) & (part[:, -1] == 10)
                    keep = (slot >= start) & (slot < stop)
                    cols = [pa.array(slot), pa.array(np.full(len(part), shard, np.int32)), pa.array(np.arange(lo, lo + len(part)) * step), pa.array(index.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(crc.astype(np.int64)), pa.array(ids, pa.binary()), pa.array(sound)]
                    yield pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "byte_offset", "sequence", "n_tokens", "crc32", "ids", "sound"]).filter(pa.array(keep))

    return files.mapInArrow(parse, schema)


def ordered(docs: DataFrame, text_col: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Write ``docs`` to the shared folder in training order and read every record back. Nulls, empty
    and repeated rows as in ``write``; an empty table gives no record."""
    path = work_path(docs.sparkSession, "order")
    write(docs, path, text_col, length, shard_rows, key)
    return read(docs.sparkSession, path)
