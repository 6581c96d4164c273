"""Queries on test passages in documents (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import leakage
from ledgerloom.runtime import table


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), "doc_id", table(spark, root, "eval_items"), "item_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least half of an item's words in one passage, and the item."""
    return _leaks(spark, root).select("doc_id", "item_id")


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Per item how many documents hold it and how much of it at most."""
    found = _leaks(spark, root).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max(F.col("matched") / F.col("n_words")).alias("max_share"))
    return table(spark, root, "eval_items").select("item_id", "suite").join(found, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLES: dict[str, str] = {}
