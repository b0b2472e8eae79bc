"""Session settings, shared work tables and column hygiene for the training-data operators.

Every function that runs on executors is shipped by value, so executors need neither this
repository on their disks nor a zip of it.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["palimpsest.llm"])

#: Arrow batches stay small whatever the length of the texts.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: Folders made by this process for sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (tests only) a fresh local one."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = context.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        there = _OWN[app]
    return there.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at committed files."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_table = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a work table that nothing will read any more."""
    context = df.sparkSession.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(df.work_table)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


class Work:
    """Work tables of one job, deleted together once nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialise(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        while self.tables:
            table = self.tables.pop()
            if hasattr(table, "work_table"):
                remove(table)


#: A key is hot from this share of the rows on, but not below so many rows; there are fewer than HOT_SHARE such keys.
HOT_ROWS, HOT_SHARE = 1_000, 1_000
#: A table of a few longs a row is broadcast up to so many counted rows (well below 64 MB).
BROADCAST_ROWS = 250_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table only when its counted rows are few; otherwise let it be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``table``, which has one row a key and in ``n`` the number of rows
    that have it.

    Hot keys, under HOT_SHARE of them, are broadcast, so their rows stay where they are; the others are
    shuffled. ``n`` is dropped. ``rows`` and ``table`` are read twice: both should be written tables."""
    key = [key] if isinstance(key, str) else key
    if total <= HOT_ROWS:  # no key can be hot
        return rows.join(table.drop(n), key, how)
    hot = F.col(n) > max(HOT_ROWS, total // HOT_SHARE)
    heavy = F.broadcast(table.filter(hot).drop(n))
    cold = rows.join(heavy.select(*key), key, "left_anti").join(table.filter(~hot).drop(n), key, how)
    return rows.join(heavy, key).unionByName(cold)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
