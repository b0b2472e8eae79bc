"""The folder for tables that a job writes down for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors share; on a local master without one (tests), in
    a temporary folder."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
