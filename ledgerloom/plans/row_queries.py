"""Queries on records that fail to parse (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import rows
from ledgerloom.runtime import table

FEEDS = [
    rows.Feed("bank_bofa", ("Posting Date", "Description", "Amount", "Type", "Memo"), ("Amount",)),
    rows.Feed("quickbooks_sample", ("Date", "Description", "Payee", "Category", "Amount", "Account"), ("Amount",)),
    rows.Feed("toast_sample", ("order_id", "date", "location", "item_id", "quantity", "price", "total", "payment_type", "tip", "tax", "refund", "void"), ("total",)),
]


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Every record of the three feeds that fails, with the first reason that applies."""
    raw = table(spark, root, "raw_records").where(F.col("feed").isin([f.name for f in FEEDS]))
    return rows.rejected(raw, "raw_text", "feed", FEEDS).select("record_id", "reason")


def p6_broken_fields(spark: SparkSession, root: str) -> DataFrame:
    """Failures per feed, reason and first broken field, beside the feed's number of records."""
    raw = rows.classify(table(spark, root, "raw_records"), "raw_text", "feed", FEEDS)
    counted = raw.groupBy("feed", "reason", "broken_field").agg(F.count("*").alias("n"))
    return counted.where("reason is not null")


def _loaded(feed: rows.Feed):
    def query(spark: SparkSession, root: str) -> DataFrame:
        return rows.load(table(spark, root, "raw_records"), "raw_text", "feed", feed, ("record_id",))

    query.__doc__ = f"Valid records of {feed.name} with their fields and decimal amounts."
    return query


QUERIES = {"p6_found": p6_found, "p6_broken_fields": p6_broken_fields} | {f"p6_load_{f.name}": _loaded(f) for f in FEEDS}
ORACLES: dict[str, str] = {}
