"""Corpus files and tables: which files count, reading them, writing results, skipping what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import segment_full

EXTENSIONS = ("txt", "doc", "docx", "pdf")


def wanted(path: Column, sidecar: str = ".index") -> Column:
    """Files by extension, any case; nothing from the sidecar folder, no dot files, no files in a dot folder."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    return F.lower(name).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$") & ~F.contains(path, F.lit(sidecar)) & ~name.startswith(".") & ~folder.startswith(".")


def scan(spark: SparkSession, folder: str, sidecar: str = ".index") -> DataFrame:
    """``(path, length, content)`` of the wanted files below ``folder``, any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(wanted(F.col("path"), sidecar)).select("path", "length", "content")


def sidecar_texts(spark: SparkSession, folder: str, sidecar: str = ".index", depth: int = 16) -> DataFrame:
    """Text sidecars below ``folder``, at most ``depth`` folders down: ``(path, text)``. Spark's listing passes over
    dot folders, so each level's sidecar folders are named by a pattern; levels without any are left out."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    levels = [f"{folder.rstrip('/')}{'/*' * k}/{sidecar}" for k in range(depth)]
    there = [x for x in levels if len(fs.globStatus(path(x)) or ())]
    if not there:
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.option("pathGlobFilter", "*.txt").text(there, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Plain texts, a row a file: ``(doc_id, path, text)`` with an id that hangs on the path alone."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.filter(F.lower("path").endswith(".txt")).select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_pages(pages: DataFrame, segment: bool = False) -> DataFrame:
    """Text extracted page by page ``(doc_id, page_no, text)`` as one text a document, in page order. With
    ``segment`` each page is cut into lines by itself, so a numeric run ends with its page."""
    if segment:
        key = F.struct("doc_id", "page_no").alias("key")
        pages = segment_full(pages.select(key, "text"), "key").select("key.doc_id", "key.page_no", "text")
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def join_paragraphs(paragraphs: Column, single_line: bool = False) -> Column:
    return F.array_join(F.filter(paragraphs, lambda x: x != ""), "" if single_line else "\n")


def new_only(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have no result yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def queue(requests: DataFrame) -> DataFrame:
    """Each (source, target) once."""
    return requests.dropDuplicates(["src", "target"])


def write_results(matches: DataFrame, ranked: DataFrame, run: DataFrame, path: str, name: str = "last") -> None:
    """A run's result log: matched lines, documents and one row about the run, each a table in a folder of the
    run's name. A run of the same name is replaced, others stay."""
    matches.write.mode("overwrite").parquet(f"{path}/match_lines/run={name}")
    ranked.write.mode("overwrite").parquet(f"{path}/doc_matches/run={name}")
    run.write.mode("overwrite").parquet(f"{path}/runs/run={name}")


def read_results(spark: SparkSession, path: str, name: str = "last") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of the named run."""
    return tuple(spark.read.parquet(f"{path}/{t}/run={name}") for t in ("match_lines", "doc_matches", "runs"))


def write_csv(results: DataFrame, path: str) -> None:
    """Every field in quotes; quotes inside are doubled, so it reads back."""
    results.write.mode("overwrite").option("quoteAll", "true").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("escape", '"').option("multiLine", "true").csv(path)
