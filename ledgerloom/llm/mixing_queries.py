"""Queries on mixing sources (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing
from ledgerloom.runtime import table


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, root, "documents"), "doc_id", table(spark, root, "mix_targets"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The documents drawn, with their tokens and how often each is used."""
    return _mixed(spark, root)[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mixed(spark, root)[1]


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
