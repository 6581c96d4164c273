"""Queries on records that stand in several splits (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import overlap
from ledgerloom.runtime import table


def _classed(spark: SparkSession, root: str) -> DataFrame:
    return overlap.same_record_classes(table(spark, root, "gold_transactions"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Each pair of same records of which one is in train, the other in validation or test."""
    return overlap.cross_split_pairs(_classed(spark, root), table(spark, root, "gold_splits")).select("id_a", "id_b")


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    """Overlaps per evaluation split and source of the evaluation row: rows, overlapping rows, pairs."""
    splits = table(spark, root, "gold_splits")
    per_row = overlap.cross_split_records(_classed(spark, root), splits).select("id", "n_train")
    held = splits.where("split in ('validation', 'test')").join(table(spark, root, "gold_transactions").select("id", "source"), "id")
    counted = held.join(per_row, "id", "left").groupBy("split", "source")
    return counted.agg(F.count("*").alias("n_rows"), F.count("n_train").alias("n_overlapping"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_pairs"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
ORACLES: dict[str, str] = {}
