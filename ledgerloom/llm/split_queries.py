"""Queries on splits by entity (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import splits
from ledgerloom.runtime import table


def _assigned(spark: SparkSession, root: str) -> DataFrame:
    gold = table(spark, root, "gold_transactions").select("id", "source", "merchant_norm")
    return splits.assign(gold, splits.entity_keys(F.col("merchant_norm"), F.col("source")))[0]


def p5_splits(spark: SparkSession, root: str) -> DataFrame:
    """Every row with its group and split."""
    return _assigned(spark, root).select("id", "source", "root", "split")


def p5_shares(spark: SparkSession, root: str) -> DataFrame:
    """Rows, groups and share of every split."""
    per = _assigned(spark, root).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("root").alias("n_groups"))
    return per.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(F.lit(0))))


QUERIES = {"p5_splits": p5_splits, "p5_shares": p5_shares}
ORACLES: dict[str, str] = {}
