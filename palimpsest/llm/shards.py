"""Sharding by balanced label propagation.

Documents with equal texts are linked. Labels (shards) start at random by row. In each round,
joins tell every group which shards with room hold most of it, and its other members move
there as far as the shards' quotas of bytes go, so fewer links are cut. State is held per
(group, shard), at most one row for each shard however large a group is, and rows of one group
all have the same size. When no move is left, unlinked documents even out the sizes: the few
that are large against a shard go, largest first, to the emptiest; the rest are laid along a
line by a two-level running sum and the line is cut where the shards' remaining room ends.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, materialise

SHARDS = 40
ROUNDS = 6
#: A document counts as large from this share of a shard on; so there are at most SHARDS / LARGE such.
LARGE = 0.004
#: Rows for each bucket of the running sums; groups above it are cut within a shard's order.
BUCKET_ROWS = 20_000
#: Least number of buckets, so that small tables are spread as well.
BUCKETS = 640


def _unit(*cols: str) -> Column:
    """A fixed number in [0, 1) for a row."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _loads(state: DataFrame, shards: int) -> list[float]:
    out = [0.0] * shards
    for r in state.groupBy("shard").agg(F.sum("bytes").alias("b")).collect():  # at most one row a shard
        out[r["shard"]] = float(r["b"])
    return out


def _floats(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def propagate(state: DataFrame, quota: float, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``state(g, shard, bytes)``: how much of each group a shard holds -> the same after propagation.

    A group's core is the fewest of its shards, most of it first, that have room for all of it: one for
    any group but the largest. Members elsewhere move to the core, by its shards' room. A shard whose
    room is under a hundredth of its quota takes nobody, and incoming moves beyond the room are scaled
    down alike, so quotas hold in every round. An empty table stays empty; rows of one group and shard must be
    one row, and none may be null."""
    order = W.partitionBy("g").orderBy(F.desc("bytes"), F.xxhash64("g", "shard"), "shard")  # at most one row a shard
    group = W.partitionBy("g")
    for _ in range(rounds):
        room = [max(0.0, quota - x) for x in _loads(state, shards)]
        free = F.element_at(_floats([r if r > quota / 100 else 0.0 for r in room]), F.col("shard") + 1)
        at = state.withColumn("free", free).withColumn("total", F.sum("bytes").over(group))
        before = F.coalesce(F.sum(F.col("free") + F.col("bytes")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        at = materialise(at.withColumn("core", before < F.col("total")), "labels")
        sinks = at.filter("core and free > 0").select("g", F.col("shard").alias("to"), (F.col("free") / F.sum("free").over(group)).alias("pull"))
        moves = materialise(at.filter("not core").join(sinks, "g").select("g", "shard", "to", "pull", (F.col("bytes") * F.col("pull")).alias("bytes")), "moves")
        asked = [0.0] * shards
        for r in moves.groupBy("to").agg(F.sum("bytes").alias("b")).collect():  # at most one row a shard
            asked[r["to"]] = float(r["b"])
        if not any(asked):
            break
        share = F.element_at(_floats([min(1.0, room[s] / asked[s]) if asked[s] else 0.0 for s in range(shards)]), F.col("to") + 1)
        # A small move goes whole or not at all: a group is cut only where a quota cuts it.
        part = F.when((F.col("bytes") > quota / 100) | (F.col("pull") < 1), share).otherwise((_unit("g", "shard", "to") < share).cast("double"))
        gone = moves.select("g", "shard", "to", (F.col("bytes") * part).alias("bytes")).filter("bytes > 0")
        left = gone.select("g", "shard", (-F.col("bytes")).alias("bytes"))
        came = gone.select("g", F.col("to").alias("shard"), "bytes")
        state = at.select("g", "shard", "bytes").unionByName(left).unionByName(came).groupBy("g", "shard").agg(F.sum("bytes").alias("bytes"))
        state = materialise(state.filter("bytes > 0.5"), "state")
    return state


def _fill(loads: list[float], amount: float) -> list[float]:
    """Room of each shard so that ``amount`` brings all to one level, as far as it goes."""
    order = sorted(range(len(loads)), key=lambda s: loads[s])
    level, left = loads[order[0]], amount
    for i, s in enumerate(order):
        nxt = loads[order[i + 1]] if i + 1 < len(order) else float("inf")
        step = min((nxt - level) * (i + 1), left)
        level, left = level + step / (i + 1), left - step
        if left <= 0:
            break
    return [max(0.0, level - x) for x in loads]


def _running(df: DataFrame, rows: int, value: Column, order: list) -> DataFrame:
    """``before``: the sum of ``value`` over all earlier rows, by hashed buckets of bounded size."""
    buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int")).withColumn("value", value)
    sums = materialise(df.groupBy("bucket").agg(F.sum("value").alias("sum")), "sums")
    # One row for each bucket: a 1/BUCKET_ROWS share of the rows.
    starts = sums.select("bucket", (F.sum("sum").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("sum")).alias("start"))
    inner = F.sum("value").over(W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("value")
    return df.withColumn("inner", inner).join(starts, "bucket").withColumn("before", F.col("inner") + F.col("start"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``docs``; law ``bytes``.

    Size is the UTF-8 length of the text (null: none) plus 16. Slots count from 0 in each shard, equal
    texts side by side. Repeated rows and null ids are rows like others; an empty table gives an empty
    table; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = materialise(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").withColumn("m", F.col("n")), "groups")
    rows = materialise(lookup(rows, groups, "g", "m", n, "left").select("doc_id", "size", "text_crc32", "g", "rid", F.coalesce("n", F.lit(1)).alias("n")), "rows")
    linked, single = rows.filter("n > 1"), rows.filter("n = 1")

    quota = total / shards if n else 1.0
    state = linked.withColumn("shard", F.floor(_unit("rid", "g") * shards).cast("int")).groupBy("g", "shard").agg(F.sum("size").cast("double").alias("bytes"))
    state = propagate(materialise(state, "state"), quota, shards, rounds)
    sums = W.partitionBy("g").orderBy("shard")
    cut = state.select("g", "shard", (F.sum("bytes").over(sums) / F.sum("bytes").over(W.partitionBy("g"))).alias("upto"))
    cuts = cut.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("cuts"))  # at most one a shard
    place = lambda at: F.coalesce(F.get(F.filter("cuts", lambda c: c["upto"] > at), F.lit(0))["shard"], F.element_at("cuts", -1)["shard"])
    columns = ["doc_id", "size", "text_crc32", "g", "rid", "n"]
    cuts = materialise(cuts.join(groups.select("g", "m"), "g"), "cuts")
    homed = materialise(lookup(linked, cuts, "g", "m", n).select(*columns, "cuts"), "homed")
    whole = homed.filter(F.size("cuts") == 1).select(*columns, place(F.lit(0.0)).alias("shard"))
    split = numbered(homed.filter(F.size("cuts") > 1)).select(*columns, place((F.col("place") + 0.5) / F.col("n")).alias("shard"))
    placed = whole.unionByName(split)
    placed = materialise(placed, "placed")
    loads = _loads(placed.withColumnRenamed("size", "bytes"), shards)

    bar = LARGE * quota
    large = sorted(((r["size"], r["rid"]) for r in single.filter(F.col("size") > bar).select("size", "rid").collect()), key=lambda x: (-x[0], x[1]))  # at most shards / LARGE
    heap, homes = [(x, s) for s, x in enumerate(loads)], []
    heapq.heapify(heap)
    for size, rid in large:
        x, s = heapq.heappop(heap)
        homes.append((rid, s))
        heapq.heappush(heap, (x + size, s))
    for x, s in heap:
        loads[s] = x
    homes = rows.sparkSession.createDataFrame(homes, "rid bigint, shard int")
    big = single.filter(F.col("size") > bar).join(homes, "rid").select(*placed.columns)

    small = single.filter(F.col("size") <= bar)
    count, amount = small.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    room = _fill(loads, float(amount))
    ends = [sum(room[: s + 1]) for s in range(shards)]
    line = _running(small, count, F.col("size"), ["rid"])
    home = F.least(F.size(F.filter(_floats(ends), lambda e: e <= F.col("before") + F.col("size") / 2)), F.lit(shards - 1))
    spread = line.select("doc_id", "size", "text_crc32", "g", "rid", "n", home.cast("int").alias("shard"))
    return slots(materialise(placed.unionByName(big).unionByName(spread), "sharded"), n)


def numbered(rows: DataFrame) -> DataFrame:
    """``place``: each row's number in its group, from counted buckets of bounded size. Repeated rows are told
    apart by ``rid``."""
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid"), buckets))
    counts = rows.groupBy("g", "bucket").agg(F.count("*").alias("count"))
    before = W.partitionBy("g").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    starts = counts.select("g", "bucket", (F.sum("count").over(before) - F.col("count")).alias("start"))
    inner = F.row_number().over(W.partitionBy("g", "bucket").orderBy("rid")) - 1
    return rows.withColumn("inner", inner).join(starts, ["g", "bucket"]).withColumn("place", F.col("inner") + F.col("start"))


def slots(rows: DataFrame, n: int) -> DataFrame:
    """Gapless places in each shard: sub-buckets are counted, then numbered by themselves. Rows with a null
    doc_id come first among equal texts; an empty table gives none."""
    subs = max(BUCKETS // SHARDS, -(-n // (SHARDS * BUCKET_ROWS)))
    hot = F.col("n") > BUCKET_ROWS
    key = ["shard", "a", "b", "c"]
    rows = rows.select(
        "*",
        F.pmod(F.xxhash64("g"), F.lit(subs)).alias("a"),
        F.when(hot, F.col("g")).otherwise(F.lit(0)).alias("b"),
        F.when(hot, F.pmod(F.xxhash64("rid"), F.lit(subs))).otherwise(F.lit(0)).alias("c"),
    )
    counts = rows.groupBy(*key).agg(F.count("*").alias("count"))
    before = W.partitionBy("shard").orderBy("a", "b", "c").rowsBetween(W.unboundedPreceding, 0)
    starts = counts.select(*key, (F.sum("count").over(before) - F.col("count")).alias("start"))
    inner = F.row_number().over(W.partitionBy(*key).orderBy("g", "doc_id", "rid")) - 1
    out = rows.withColumn("inner", inner).join(starts, key)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("inner") + F.col("start")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
