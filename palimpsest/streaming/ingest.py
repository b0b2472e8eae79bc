"""New target documents as a stream: each micro-batch is matched against a fixed set of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import SearchParams, search


def watch(spark: SparkSession, folder: str, sources: DataFrame, out: str, checkpoint: str, params: SearchParams = SearchParams(), schema: str = "doc_id bigint, text string", once: bool = True) -> StreamingQuery:
    """Match documents that arrive as Parquet in ``folder``; results are appended under ``out`` by batch.

    A batch's tables are written to a folder of its number, overwritten when the batch is run again, so
    a restart neither loses nor doubles results."""

    def batch(docs: DataFrame, number: int) -> None:
        with search(sources, docs, params) as found:
            found.matches.write.mode("overwrite").parquet(f"{out}/match_lines/batch={number}")
            found.ranked.write.mode("overwrite").parquet(f"{out}/doc_matches/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
