"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import (licenses, mixing, near, pages, periodic, quality, secrets, shards, spellings, substrings, templates, tokens,
                         vectors)
from runlens.llm.common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(documents(spark, sf_dir, "pages"))


def op6_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_report(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contamination_report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_report(documents(spark, sf_dir))


def op12_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_links(documents(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(documents(spark, sf_dir), replace=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    job.__name__: job
    for job in (op1_quality_rules, op2_substring_dedup, op3_token_counts, op4_secret_scan, op5_html_extraction, op6_minhash_near,
                op7_sharding, op8_decontamination, op9_license_scan, op10_mixing, op11_spelling_variants, op12_embedding_near,
                op13_periodic_runs)
}
ORACLES: dict[str, str] = {"op11_spelling_variants": spellings.ORACLE, "op12_embedding_near": vectors.ORACLE}
