"""Queries on new batches against history (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import incremental
from ledgerloom.runtime import Scratch, table, written


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that repeat a record of an earlier batch: the batches are accepted one group after the other."""
    with Scratch(spark, "history") as scratch:
        return written(incremental.replay(table(spark, root, "gold_transactions"), scratch.folder).repeats(), "repeats")


def p4_batches(spark: SparkSession, root: str) -> DataFrame:
    """Per batch its rows and how many of them repeat a record accepted before."""
    gold = table(spark, root, "gold_transactions")
    found = p4_found(spark, root).select(F.col("id_b").alias("id"), F.lit(1).alias("hit"))
    joined = gold.select("id", "ingest_batch").join(found, "id", "left")
    return joined.groupBy("ingest_batch").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_repeats"))


QUERIES = {"p4_found": p4_found, "p4_batches": p4_batches}
ORACLES: dict[str, str] = {}
