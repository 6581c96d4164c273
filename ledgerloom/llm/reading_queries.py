"""Queries on reading levels (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import reading
from ledgerloom.runtime import table


def _levels(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    running = documents.where("lang = 'en' and source <> 'receipt_ocr'")
    ranker = reading.train(running, table(spark, root, "reading_labels"), "doc_id")
    return reading.levels(running, "doc_id", ranker)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Reading level of every English running text."""
    return _levels(spark, root).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, root: str) -> DataFrame:
    """Documents per source and reading level."""
    sources = table(spark, root, "documents").select("doc_id", "source")
    return _levels(spark, root).join(sources, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
ORACLES: dict[str, str] = {}
