"""A training corpus from raw documents: five stages of the optional subpackage.

Defined results, besides those that the operators' docstrings state: every stage but
the last returns the columns of its documents, in order, whatever they are named, and
an empty table for an empty one. Rows with a null id are documents: they are scored, masked,
mixed (as one hash) and packed, and never duplicates. Rows that repeat an id stay or go
together in near_dedup and mix, and are packed each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import mixing, near_dedup, ordinal, packing, pii
from lodestrata.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier, fitted on the labelled ones among them, selects; without labels all."""
    return ordinal.select_documents(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest id; null and wordless texts all stay."""
    return near_dedup.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars that of the masked text; null texts stay null."""
    return pii.redacted(docs, entities_name=None, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents within their sources' budgets of tokens; a null source is one of its own."""
    return mixing.mixed(docs, tiers=(100,), tier_name=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go; texts without a token go nowhere."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("near_dedup", dedup), ("pii", private), ("mix", mix), ("pack", pack)]
#: Fitted models take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each hands on is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
