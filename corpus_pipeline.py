"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns what goes on; run() writes each result as
Parquet in the shared checkpoint folder and reads it again. All but the last stage return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vekspar.llm import langid, packing, secrets, simhash, substring_dedup
from vekspar.llm.common import Scratch, release, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars brought in line with texts that have changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; null texts, texts without letters and the like go."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller id holds."""
    return _counted(substring_dedup.remove(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark."""
    return _counted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Language ID, secret lexing and tokenising have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
