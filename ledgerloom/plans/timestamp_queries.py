"""Queries on mixed timestamp writings (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import timestamps
from ledgerloom.runtime import table


def _rows(spark: SparkSession, root: str) -> DataFrame:
    """Every timestamp text of the three tables, with its key, source and place in the order of arrival."""
    staging = table(spark, root, "staging_transactions").select(
        F.lit("staging_transactions").alias("tbl"), F.col("rowid").cast("string").alias("row_key"), F.col("rowid").alias("seq"), F.col("txn_ts").alias("text"), "source"
    )
    canonical = table(spark, root, "canonical_records").select(
        F.lit("canonical_records").alias("tbl"), F.col("id").alias("row_key"), F.regexp_extract("id", r"(\d+)$", 1).try_cast("long").alias("seq"), F.col("transaction_date").alias("text"), "source"
    )
    bank = table(spark, root, "bank_bofa").select(
        F.lit("bank_bofa").alias("tbl"), F.col("record_id").cast("string").alias("row_key"), F.col("record_id").alias("seq"), F.col("`Posting Date`").alias("text"), F.lit("bank_bofa").alias("source")
    )
    return staging.unionByName(canonical).unionByName(bank).where("text is not null and text <> ''")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every row whose text differs from its one unambiguous form."""
    norm = timestamps.normalise(_rows(spark, root), "text", "source", "seq", table(spark, root, "source_profiles"))
    return norm.where("norm <> text").select("tbl", "row_key", "norm")


def p2_zones(spark: SparkSession, root: str) -> DataFrame:
    """Zone estimated from the order of arrival beside the declared one, for every source of staging_transactions."""
    profiles = table(spark, root, "source_profiles")
    rows = table(spark, root, "staging_transactions").join(profiles, "source")
    parsed = timestamps.parse(rows, "txn_ts", "date_order")
    zones = sorted(r.zone for r in profiles.select("zone").distinct().collect())
    found = timestamps.estimate_zones(parsed, "source", "rowid", zones)
    return found.join(profiles.select("source", F.col("zone").alias("declared")), "source")


QUERIES = {"p2_found": p2_found, "p2_zones": p2_zones}
ORACLES: dict[str, str] = {}
