"""The registered queries of this subpackage and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, licenses, order, passages, pieces, pii, quality, rules, shards, simhash, turns
from .common import documents, tuned


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encoded(documents(spark, sf_dir))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return done.select("doc_id", "n_tokens", "n_byte_tokens", digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "parity")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ordered(documents(spark, sf_dir)).drop("ids")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document's is its source, its language and its id."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return licenses.scan(documents(spark, sf_dir), path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored(documents(spark, sf_dir))


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(documents(spark, sf_dir))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    return chat.formatted(chat.logged(rows.unionByName(extra)))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    events = turns.replayed(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    said = F.when(F.col("event") == "close", F.col("waiting")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", F.sha2(said.cast("binary"), 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.cleaned(documents(spark, sf_dir))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_pii_spans,
        op3_training_order,
        op4_license_scan,
        op5_quality_rules,
        op6_balanced_shards,
        op7_benchmark_leaks,
        op8_quality_classifier,
        op9_chat_format,
        op10_simhash_components,
        op11_source_divergence,
        op12_turn_reassembly,
        op13_repeated_passages,
    )
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.op4_sql(),
    "op5_quality_rules": rules.op5_sql(),
    "op7_benchmark_leaks": decontaminate.op7_sql(),
    "op11_source_divergence": divergence.op11_sql(),
    "op12_turn_reassembly": turns.op12_sql(),
    "op13_repeated_passages": passages.op13_sql(),
}
