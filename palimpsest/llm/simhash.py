"""SimHash fingerprints and exact Hamming linkage by a Gray-order hierarchical index.

Fingerprints are spread over tasks by the pigeonhole rule (two words that differ in at most k
bits agree on at least m - k of m blocks). Inside a task they are sorted by Gray rank, and a
tree of nodes is built over the sorted run; each node holds the bit pattern its members share
and the mask of the bits where they agree. Two nodes are compared through their masks: the
differences that the shared patterns already force are a lower bound for every pair below, so
whole groups are pruned at once; groups that are linked already are not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise
from .graph import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Largest number of fingerprints that one task compares with each other; larger buckets are tiled.
TILE = 16_384
#: Wanted mean bucket size; more blocks are matched when a corpus would exceed it.
BUCKET = 4_096
LEAF = 32

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the four-word shingles in order; of fewer words, of the whole sequence; none of none."""
    import xxhash

    x, n = xxhash.xxh64_intdigest, len(words)
    if n <= SHINGLE:
        return np.array([x(b" ".join(words), SEED)] if n else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE]))
    return np.fromiter((x(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())), np.uint64, n - SHINGLE + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text; 0 when it has no words (or is null)."""
    return majority(shingle_hashes(words_of(text)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: one row for each row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    g = fps.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        g = g ^ (g >> np.uint64(s))
    return g


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class GrayIndex:
    """Hierarchy over Gray-sorted fingerprints. ``levels[0]`` are leaves of ``LEAF`` words; each level
    above pairs up neighbours. A level is (both, either): AND and OR of the members' bits; the bits
    where a node's members agree are ``~(both ^ either)``."""

    def __init__(self, fps: np.ndarray):
        order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[order]
        self.order = order
        n = len(fps)
        cuts = np.arange(0, n, LEAF)
        both, either = np.bitwise_and.reduceat(self.fps, cuts), np.bitwise_or.reduceat(self.fps, cuts)
        self.levels = [(both, either)]
        while len(both) > 1:
            cuts = np.arange(0, len(both), 2)
            both, either = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)
            self.levels.append((both, either))

    def link(self, bits: int) -> Iterator[tuple[int, int]]:
        """A spanning forest of the pairs at ``bits`` or fewer differences, as positions in the input."""
        sets = _Sets(len(self.fps))
        whole: dict[tuple[int, int], bool] = {}

        def single(level: int, i: int) -> bool:
            """All members of a node are in one set (then it stays so)."""
            if (level, i) in whole:
                return True
            lo, hi = (i << level) * LEAF, min(len(self.fps), ((i + 1) << level) * LEAF)
            r = sets.find(lo)
            if all(sets.find(k) == r for k in range(lo + 1, hi)):
                whole[level, i] = True
                return True
            return False

        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            both, either = self.levels[level]
            if i != j:
                apart = (both[i] & ~either[j]) | (both[j] & ~either[i])
                if int(apart).bit_count() > bits:
                    continue
            if level <= 3 and single(level, i) and (i == j or single(level, j) and sets.find((i << level) * LEAF) == sets.find((j << level) * LEAF)):
                continue
            if level:
                top = len(self.levels[level - 1][0])
                kids = [(a, b) for a in (2 * i, 2 * i + 1) for b in (2 * j, 2 * j + 1) if a < top and b < top and (i != j or a <= b)]
                kids.sort(key=lambda k: k[0] == k[1])  # each half by itself first
                stack += [(level - 1, a, b) for a, b in kids]
                continue
            a0, b0 = i * LEAF, j * LEAF
            near = np.bitwise_count(self.fps[a0 : a0 + LEAF, None] ^ self.fps[None, b0 : b0 + LEAF]) <= bits
            for x, y in zip(*np.nonzero(near)):
                x, y = a0 + int(x), b0 + int(y)
                if x < y and sets.join(x, y):
                    yield int(self.order[x]), int(self.order[y])


def scheme(n: int, bits: int = MAX_BITS, bucket: int = BUCKET) -> tuple[int, int]:
    """(blocks, blocks that must agree): the fewest for which evenly spread words fill buckets of about ``bucket``."""
    for m in range(bits + 1, 13):
        if n >> (64 // m * (m - bits)) <= bucket:
            return m, m - bits
    return 12, 12 - bits


def _keys(fp: Column, blocks: int, same: int) -> Column:
    """Bucket keys of one fingerprint: which blocks agree, and their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), same)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).alias("set"), fp.bitwiseAND(F.lit(signed).cast("bigint")).alias("bits")))
    return F.array(*keys)


def _packed_forests(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Buckets arrive sorted by key; each is linked when its last row has come."""
    held_key, held = None, []

    def flush() -> pa.RecordBatch | None:
        fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        if len(fps) < 2:
            return None
        pairs = np.array(list(GrayIndex(fps).link(bits)), np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], names=["u", "v"]) if len(pairs) else None

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        fp = b.column(4).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            key = tuple(k[:, lo].tolist())
            if key != held_key:
                if (out := flush()) is not None:
                    yield out
                held_key, held = key, []
            held.append(fp[lo:hi])
    if (out := flush()) is not None:
        yield out


def forest(distinct: DataFrame, n: int, bits: int = MAX_BITS, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """``distinct(fp)`` -> ``(u, v)``: links whose transitive closure is that of all pairs within ``bits``.

    Buckets of more than ``tile`` words are cut into runs of consecutive Gray ranks; two runs meet in
    a task only if the bits that their members share leave at most ``bits`` differences.
    """
    blocks, same = scheme(n, bits, bucket)
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), blocks, same)).alias("k")).select("fp", F.col("k.set").alias("set"), F.col("k.bits").alias("bits"))
    size = keyed.groupBy("set", "bits").agg(F.count("*").alias("size")).filter("size > 1").withColumn("n", F.col("size"))
    keyed = lookup(keyed, size, ["set", "bits"], "n", n * len(list(combinations(range(blocks), same))))
    small = keyed.filter(F.col("size") <= tile).select("set", "bits", F.lit(0).alias("t1"), F.lit(0).alias("t2"), "fp")
    rank = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    big = keyed.filter(F.col("size") > tile).withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))
    cuts = big.groupBy("set", "bits", "size").agg(F.percentile_approx("rank", [i / 65 for i in range(1, 65)], 1000).alias("grid")).select("set", "bits", (F.ceil(F.col("size") / tile)).cast("int").alias("parts"), "grid")
    # At most 64 cuts at a time: each tile of a far larger bucket is cut again by the word's low hash.
    # One row for each bucket above the tile size, with 64 numbers.
    tiled = big.join(cuts, ["set", "bits"]).select(
        "set", "bits", "fp",
        (F.size(F.filter("grid", lambda c: c < F.col("rank"))) * F.greatest(F.lit(1), F.ceil(F.col("parts") / 65).cast("int")) + F.pmod(F.xxhash64("fp"), F.greatest(F.lit(1), F.ceil(F.col("parts") / 65).cast("int"))).cast("int")).alias("t"),
    )
    shape = tiled.groupBy("set", "bits", "t").agg(F.expr("bit_and(fp)").alias("both"), F.expr("bit_or(fp)").alias("either"))
    other = shape.select("set", "bits", F.col("t").alias("t2"), F.col("both").alias("both2"), F.col("either").alias("either2"))
    apart = F.bit_count(F.expr("(both & ~either2) | (both2 & ~either)"))
    pairs = shape.join(other, ["set", "bits"]).filter((F.col("t") <= F.col("t2")) & (apart <= bits)).select("set", "bits", F.col("t").alias("t1"), "t2")
    sides = pairs.select("set", "bits", "t1", "t2", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("t"))
    large = tiled.join(sides, ["set", "bits", "t"]).select("set", "bits", "t1", "t2", "fp")
    where = F.hash("set", "bits", "t1", "t2")
    dealt = small.unionByName(large).withColumn("h", where).repartition("h").sortWithinPartitions("set", "bits", "t1", "t2").drop("h")
    return dealt.mapInArrow(lambda b: _packed_forests(b, bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``: ids whose fingerprints are linked through
    steps of at most ``bits`` differing bits share a component, named by its least id.

    Null texts and texts without words have fingerprint 0 and are linked like any other. A null id
    keeps its row and never names a component unless no other id is there. Repeated rows stay.
    An empty table gives an empty table. Columns other than the two named ones are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col), "fps")
    found = rooted(fps, bits, tile, bucket)
    named = materialise(found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "named")
    names = materialise(lookup(found, named, "root", "size", found.count()).select("fp", "n", "component_id"), "names")
    return lookup(fps, names, "fp", "n", fps.count()).select("id", "fp", "component_id")


def rooted(fps: DataFrame, bits: int = MAX_BITS, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """``fps(id, fp)`` -> ``(fp, least, n, root)`` for each distinct fingerprint: the least id and the number
    of its rows, and the least fingerprint that it is linked to."""
    least = materialise(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "least")
    roots = components(forest(least.select("fp"), least.count(), bits, tile, bucket)).withColumnRenamed("node", "fp")
    return materialise(least.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
