"""Connected components over an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, lookup, materialise, remove

#: A table of at most so many edges is finished by one task.
FEW_EDGES = 200_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step over a written table of ``total`` edges; nodes of very many edges are not dealt to one task."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        return lookup(near, least, "u", "n", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = lookup(down, least, "u", "n", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) by union-find over the edges of one task."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every node on an edge; root is the least node of its component.

    Self-loops and repeated edges are ignored; an empty table gives an empty table. Rounds of joins are
    written to the shared folder, so a lost executor costs at most one round; finished rounds are
    deleted. A table of at most ``few`` edges is finished by one task, in bounded memory. Only two
    numbers a round reach the driver."""
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0] > few:
        if mark[0] <= HOT_ROWS // 4:  # no node can have too many edges
            made = materialise(_star(_star(now, True, 0), False, 0), "edges")
        else:
            half = materialise(_star(now, True, mark[0]), "edges")
            made = materialise(_star(half, False, half.count()), "edges")
            remove(half)
        was, mark = mark, _mark(made)
        remove(now)
        now = made
        if was == mark:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
    kind = now.schema["u"].dataType.simpleString()
    return materialise(now.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "joined")
