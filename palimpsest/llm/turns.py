"""Conversation turns put together from a stream of late, repeated and disordered arrivals.

Conversations are hashed to buckets, and a bucket is one group of ``applyInPandasWithState``: its state
is two Arrow tables, compressed with zstd, of all conversations in it (where each stands, and the turns that
wait for an earlier one). Every batch brings one tick row for each bucket, so a bucket is called, and its
silent conversations age, in empty batches as well. A call merges all arrivals of its bucket at once with
numpy: sorted search, first arrival wins, and the gapless run from the first turn on is released.

Released turns leave the state: what stays of them is the next turn wanted, the last role and the number of
roles that were repeated. A closed conversation leaves its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, materialise, work_path

#: Batches of the query, and successive ones without arrivals that close a conversation.
BATCHES, SILENT = 8, 3
#: Rows of one bucket, about.
BUCKET_ROWS = 2_000
EVENTS = "event string, conv_id bigint, turn bigint, batch bigint, role string, text string, n_missing bigint, n_breaks bigint, waiting string"
_STATE = "convs binary, waiting binary"
#: conv: first turn, next turn wanted, role of the turn before it, repeated roles so far, batch of the last arrival, closed.
_CONVS = pa.schema([("conv", pa.int64()), ("first", pa.int64()), ("next", pa.int64()), ("role", pa.string()), ("breaks", pa.int64()), ("seen", pa.int64()), ("closed", pa.bool_())])
_WAITING = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _frozen(columns: dict, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema))
    return sink.getvalue().to_pybytes()


def _thawed(data: bytes | None, schema: pa.Schema) -> dict:
    table = pa.ipc.open_stream(data).read_all() if data else schema.empty_table()
    return {f.name: table.column(f.name).to_numpy(zero_copy_only=False) for f in schema}


@dataclass
class Bucket:
    """All conversations of a bucket. ``convs`` is sorted by conversation, ``waiting`` by conversation and turn."""

    convs: dict
    waiting: dict

    def open(self, conv: np.ndarray, first: np.ndarray, batch: int) -> None:
        names, at = np.unique(conv, return_index=True)
        new = ~np.isin(names, self.convs["conv"])
        names, begin = names[new], first[at][new]
        n = len(names)
        fresh = {"conv": names, "first": begin, "next": begin, "role": np.full(n, None, object), "breaks": np.zeros(n, np.int64), "seen": np.full(n, batch), "closed": np.zeros(n, bool)}
        both = {k: np.concatenate((v, fresh[k])) for k, v in self.convs.items()}
        order = np.argsort(both["conv"], kind="stable")
        self.convs = {k: v[order] for k, v in both.items()}

    def take(self, batch: int, conv: np.ndarray, turn: np.ndarray, role: np.ndarray, text: np.ndarray, first: np.ndarray) -> list[dict]:
        """Arrivals of one batch, of each turn one: rejected, kept, or dropped as repeats; then what became gapless."""
        self.open(conv, first, batch)
        c, w = self.convs, self.waiting
        at = np.searchsorted(c["conv"], conv)
        late = c["closed"][at]
        out = [{"event": "reject", "conv_id": conv[late], "turn": turn[late], "role": role[late], "text": text[late]}]
        c["seen"][at[~late]] = batch
        fresh = ~late & (turn >= c["next"][at])
        merged = {k: np.concatenate((w[k], v[fresh])) for k, v in (("conv", conv), ("turn", turn), ("role", role), ("text", text))}
        order = np.lexsort((merged["turn"], merged["conv"]))  # stable: what waited comes before what repeats it
        w = {k: v[order] for k, v in merged.items()}
        new = np.ones(len(order), bool)
        new[1:] = (w["conv"][1:] != w["conv"][:-1]) | (w["turn"][1:] != w["turn"][:-1])
        w = {k: v[new] for k, v in w.items()}
        at = np.searchsorted(c["conv"], w["conv"])
        free = w["turn"] - c["next"][at] == np.arange(len(at)) - np.searchsorted(w["conv"], w["conv"])
        done, self.waiting = {k: v[free] for k, v in w.items()}, {k: v[~free] for k, v in w.items()}
        out.append({"event": "release", "conv_id": done["conv"], "turn": done["turn"], "role": done["role"], "text": done["text"]})
        if free.any():
            names, start, size = np.unique(done["conv"], return_index=True, return_counts=True)
            here = np.searchsorted(c["conv"], names)
            before = np.concatenate(([None], done["role"][:-1]))
            before[start] = np.where(c["next"][here] > c["first"][here], c["role"][here], None)
            c["breaks"][here] += np.add.reduceat((before == done["role"]).astype(np.int64), start)
            c["next"][here] += size
            c["role"][here] = done["role"][start + size - 1]
        return out

    def close(self, due: np.ndarray) -> dict:
        """Closes the conversations at ``due``; what waits there is given up."""
        c, w = self.convs, self.waiting
        names = c["conv"][due]
        start, end = np.searchsorted(w["conv"], names), np.searchsorted(w["conv"], names, "right")
        left = end - start
        top = np.where(left > 0, w["turn"][np.maximum(end - 1, 0)], c["next"][due] - 1) if len(w["turn"]) else c["next"][due] - 1
        follows = np.zeros(len(w["turn"]) + 1, np.int64)
        follows[1:-1] = (w["conv"][1:] == w["conv"][:-1]) & (w["turn"][1:] == w["turn"][:-1] + 1) & (w["role"][1:] == w["role"][:-1]) if len(w["turn"]) > 1 else 0
        upto = np.concatenate(([0], np.cumsum(follows)))
        breaks = c["breaks"][due] + np.where(left > 0, upto[end] - upto[np.minimum(start + 1, len(follows) - 1)], 0)
        numbers = [",".join(map(str, w["turn"][s:e].tolist())) for s, e in zip(start, end)]
        out = {"event": "close", "conv_id": names, "turn": np.full(len(names), -1), "waiting": np.array(numbers, object), "n_missing": top - c["next"][due] + 1 - left, "n_breaks": breaks}
        c["closed"][due] = True
        c["role"][due] = None
        stays = ~np.isin(w["conv"], names)
        self.waiting = {k: v[stays] for k, v in w.items()}
        return out


def _row_frames(parts: list[dict], batch: int) -> Iterator[pd.DataFrame]:
    for p in parts:
        n = len(p["conv_id"])
        for at in range(0, n, 1_000):
            cut = slice(at, at + 1_000)
            frame = pd.DataFrame({k: v[cut] for k, v in p.items() if k != "event"})
            frame.insert(0, "event", p["event"])
            frame["batch"] = batch
            for name in ("role", "text", "waiting", "n_missing", "n_breaks"):
                if name not in frame:
                    frame[name] = pd.array([None] * len(frame), "Int64") if name.startswith("n_") else None
            yield frame[[f.split()[0] for f in EVENTS.split(", ")]]


def assembled(stream: DataFrame, ends: int, silent: int = SILENT) -> DataFrame:
    """Events of a stream of ``(bucket, batch, conv_id, turn, first, role, text)``, one micro-batch a batch; a
    tick row has a null role, arrivals have none. The tick of batch ``ends`` closes what is open.

    A conversation opens with any arrival and closes in the last of ``silent`` successive batches without
    any; all later arrivals are rejected. Of a turn the earliest arrival stays. A turn below ``first`` counts
    as a repeat."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames), ignore_index=True)
        batch = int(whole["batch"].max())
        rows = whole[whole["role"].notna()]
        held = state.get if state.exists else (None, None)
        bucket = Bucket(_thawed(held[0], _CONVS), _thawed(held[1], _WAITING))
        numbers = [rows[c].to_numpy(np.int64) for c in ("conv_id", "turn", "first")]
        out = bucket.take(batch, *numbers[:2], rows["role"].to_numpy(object), rows["text"].to_numpy(object), numbers[2])
        c = bucket.convs
        out.append(bucket.close(np.flatnonzero(~c["closed"] & ((batch - c["seen"] >= silent) | (batch >= ends)))))
        state.update((_frozen(bucket.convs, _CONVS), _frozen(bucket.waiting, _WAITING)))
        yield from _row_frames(out, batch)

    return stream.groupBy("bucket").applyInPandasWithState(fold, EVENTS, _STATE, "append", "NoTimeout")


def staged(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Arrivals ``(bucket, batch, conv_id, turn, first, role, text)`` with their ticks, as a table written by batch.

    A row comes in the batch that the hash of its name says, and one in three or four once more, as a user's.
    Of the arrivals of a turn in a batch the one with the least payload stays; that is settled before rows
    are shuffled. Rows without a turn or a conversation are dropped; a null role or text is empty."""
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    rows = materialise(rows.filter(F.col("turn").isNotNull() & F.col("conv_id").isNotNull()), "turns")
    begins = materialise(rows.groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("n")), "begins")
    total = rows.count()
    buckets = max(16, total // BUCKET_ROWS)
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "conv_id", "turn").cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    named = lookup(rows, begins, "conv_id", "n", total).withColumn("h", h)
    arrival = F.struct((F.col("h") % batches).alias("batch"), F.col("role").alias("role"))
    again = F.struct(((F.col("h") + 3) % batches).alias("batch"), F.lit("user").alias("role"))
    all_ = named.select("conv_id", "turn", "first", "text", F.inline(F.when(F.col("h") % 7 < 2, F.array(arrival, again)).otherwise(F.array(arrival))))
    least = F.min(F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role", "text")).alias("x")
    once = all_.groupBy("batch", "conv_id", "turn", "first").agg(least).select("batch", "conv_id", "turn", "first", "x.role", "x.text")
    once = once.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    ticks = rows.sparkSession.range(buckets).select(F.explode(F.sequence(F.lit(0), F.lit(batches)).cast("array<bigint>")).alias("batch"), F.col("id").alias("bucket"), *(F.lit(0).cast("bigint").alias(c) for c in ("conv_id", "turn", "first")))
    return once.unionByName(ticks, allowMissingColumns=True)


def replayed(spark: SparkSession, rows: DataFrame, batches: int = BATCHES, silent: int = SILENT) -> DataFrame:
    """Feeds the batches of ``staged`` in order to a stateful query that is started anew for each, on one
    checkpoint in a new shared folder, and reads back the events.

    The events' files are committed with the batch, so a start that failed half-way repeats its batch and
    leaves each event once. An empty table gives no events."""
    base = work_path(spark, "reassembly")
    staged(rows, batches).write.partitionBy("batch").parquet(f"{base}/staged")
    schema = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("first", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("bucket", T.LongType()), ("batch", T.LongType()))])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/fed"))
    for batch in range(batches + 1):
        if not fs.rename(path(f"{base}/staged/batch={batch}"), path(f"{base}/fed/batch={batch}")):
            raise OSError(f"batch {batch} of {base} can't be fed")
        stream = spark.readStream.schema(schema).option("basePath", f"{base}/fed").parquet(f"{base}/fed")
        out = assembled(stream, batches, silent).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        out.option("path", f"{base}/events").option("checkpointLocation", f"{base}/checkpoint").start().awaitTermination()
    return spark.read.schema(EVENTS).parquet(f"{base}/events")


def op12_sql() -> str:
    """The same by windows over all arrivals: a conversation's end is its first gap, a turn is released
    with the latest of the turns up to it."""
    b, s = BATCHES, SILENT
    return f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST('0x' || substr(sha256(conv_id || ':' || turn), 1, 8) AS BIGINT) AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
    a AS (SELECT conv_id, turn, h % {b} AS batch, role, text FROM r UNION ALL SELECT conv_id, turn, (h + 3) % {b}, 'user', text FROM r WHERE h % 7 < 2),
    f AS (SELECT conv_id, min(turn) AS first FROM r GROUP BY conv_id),
    o AS (SELECT conv_id, turn, batch, x.payload AS payload, x.role AS role FROM (SELECT conv_id, turn, batch, min({{'payload': role || '|' || text, 'role': role}}) AS x FROM a GROUP BY ALL)),
    g AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS nxt FROM (SELECT DISTINCT conv_id, batch FROM o)),
    e AS (SELECT conv_id, least(min(batch + {s}) FILTER (WHERE coalesce(nxt, 99) - batch > {s}), {b}) AS ends FROM g GROUP BY conv_id),
    k AS (SELECT o.*, first, ends, row_number() OVER (PARTITION BY o.conv_id, turn ORDER BY batch) AS nth FROM o JOIN f USING (conv_id) JOIN e USING (conv_id)),
    kept AS (SELECT *, turn - first + 1 = row_number() OVER w AS gapless, max(batch) OVER w AS upto, role = lag(role) OVER w AND turn = lag(turn) OVER w + 1 AS breaks FROM k WHERE nth = 1 AND batch <= ends WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT 'release' AS event, sha256(payload) AS sha256, conv_id, turn, upto AS batch, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM kept WHERE gapless
    UNION ALL SELECT 'reject', sha256(payload), conv_id, turn, batch, NULL, NULL FROM k WHERE batch > ends
    UNION ALL SELECT 'close', sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT gapless), '')), conv_id, -1, max(ends), max(turn) - min(first) + 1 - count(*), count(*) FILTER (WHERE breaks) FROM kept GROUP BY conv_id"""
