"""The operators over the whole tables, with production parameters, as queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html, mixing, near_dedup, ordinal, packing, pii, rules, secrets, tokens
from .common import table, written


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects, with their scores."""
    docs = table(spark, sf_dir, "documents")
    return ordinal.selected(docs, ordinal.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "expected_grade", "tail_probability")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that no learned rule rejects, with the statistics that the rules see."""
    docs = table(spark, sf_dir, "documents")
    learned = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.judged(docs, learned).where("rule = 0").select("doc_id", "stats.*")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities masked, and where they were."""
    return pii.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents within the sources' budgets, with the least tier that holds each."""
    docs = tokens.with_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), name="tokens").drop("text")
    return mixing.mixed(written(docs, "counted"), tokens_col="tokens")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return fingerprints.fingerprint_classes(table(spark, sf_dir, "documents"))


_ALL = (op1_quality_classifier, op2_token_counts, op3_quality_rules, op4_html_extraction, op5_pii, op6_near_dedup, op7_source_mix, op8_best_fit_packing, op9_secret_scan, op10_document_fingerprints)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """None of the ten can be said in SQL: models, signatures, parsers and a tokenizer take part."""
    return {}
