"""Corpus preparation: quality rules, near-duplicates, decontamination, personal data, tokens.

Every stage reads the table that the stage before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import copies, decontaminate, pieces, pii, rules
from palimpsest.llm.common import documents, materialise, tuned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null texts have no words and go with them. Repeated rows share a fate, an empty
    table stays empty, further columns stay as they are. That holds for every stage."""
    tuned(spark)
    return rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (named by SimHash and sketches, verified: five-word shingles alike by 0.8 or more) the one
    with the least id stays; of equal rows one, of texts without words one; rows without an id all stay."""
    tuned(spark)
    return copies.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and rows without an id stay."""
    tuned(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers become placeholders; null texts stay null."""
    tuned(spark)
    return pii.redacted(docs)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids; the text that they decode to stays beside them. Null and empty texts have none."""
    tuned(spark)
    return pieces.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("subwords", subwords),
]

#: Fingerprints, disguises and subword units have no SQL form; tests hold each stage to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the stage before it wrote. Edge cases are those of the stages."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
