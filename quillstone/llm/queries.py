"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import bpe, count_trees, decontaminate, fim, licenses, line_dedup, packing, pii, quality, repair, sharding, simhash, token_store
from quillstone.llm.common import read

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=16)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_counts(read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(read(spark, sf_dir, "documents"), min_docs=10)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_trees.masked_counts(read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(read(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(read(spark, sf_dir, "documents"), BYTE_VOCABULARY, tokens=1024, segments=128)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(read(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_bpe, op3_line_dedup, op4_licenses, op5_decontamination, op6_token_output, op7_pii, op8_simhash, op9_quality, op10_token_counts, op11_repair, op12_packing, op13_fim)}
ORACLES: dict[str, str] = {"op3_line_dedup": line_dedup.ORACLE, "op13_fim": fim.ORACLE}
