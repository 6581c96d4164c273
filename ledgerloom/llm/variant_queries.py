"""Queries on variant spellings (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import variants
from ledgerloom.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Each pair of different spellings of merchant_raw that name the same payee."""
    linked = variants.spellings(table(spark, root, "canonical_records"), "merchant_raw", "merchant_norm")
    return variants.variant_pairs(linked)


def p1_payees(spark: SparkSession, root: str) -> DataFrame:
    """Payees with their spellings counted: rows, spellings, the most frequent one."""
    linked = variants.spellings(table(spark, root, "canonical_records"), "merchant_raw", "merchant_norm")
    return linked.groupBy("payee").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"), F.max_by("name", F.struct("n", "name")).alias("main_spelling"))


QUERIES = {"p1_found": p1_found, "p1_payees": p1_payees}
ORACLES: dict[str, str] = {}
