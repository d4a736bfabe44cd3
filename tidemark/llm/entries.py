"""The registered queries of the text operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, lexical_search, licenses, line_dedup, mixing, parity_join, pii, quality_classifier, quality_rules, secrets, substring_dedup, url_filter, vector_codes
from tidemark.llm.common import documents


def op1_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(documents(spark, sf_dir)).drop("class_distance", "word_distance")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components(documents(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rule_ensemble, op2_pii_sanitisation, op3_decontamination, op4_repeated_bytes, op5_line_dedup, op6_soft_mixing, op7_url_filter, op8_quality_rules, op9_secret_scan, op10_parity_sketch_join, op11_license_scan, op12_lexical_search, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op4_repeated_bytes": substring_dedup.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op7_url_filter": url_filter.ORACLE_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL, "op10_parity_sketch_join": parity_join.ORACLE_SQL, "op11_license_scan": licenses.ORACLE_SQL, "op12_lexical_search": lexical_search.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
