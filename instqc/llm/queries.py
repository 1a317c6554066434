"""One thin query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instqc.llm import (
    alignment, decontamination, exact_dedup, extraction, filter_audit, licences, lines, mixing, near_dedup, packing, quality, sharding, sql, toxicity,
)
from instqc.llm import pipeline as corpus_pipeline
from instqc.llm.common import read_table
from instqc.llm.registry import query
from instqc.session import cut_lineage


@query("op1_extraction")
def op1_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(read_table(spark, folder, "pages"))


@query("op2_exact_dedup", sql.EXACT_DEDUP)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{folder}/documents.parquet")


@query("op3_mixing", sql.MIXING)
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixing_report(read_table(spark, folder, "documents"))


@query("op4_decontamination", sql.DECONTAMINATION)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(read_table(spark, folder, "documents"))


@query("op6_near_dedup", sql.NEAR_DEDUP)
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, folder, "documents"), k=2)


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(read_table(spark, folder, "documents"))


@query("op8_licences", sql.LICENCES)
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_report(read_table(spark, folder, "documents"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, folder, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op11_packing")
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_alignment")
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align(
        read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    stored = cut_lineage(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return alignment.link_scores(stored).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_filter_audit", sql.FILTER_AUDIT)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    failures = filter_audit.document_failures(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    return filter_audit.audit(failures, "ABCDE")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
