"""All registered queries and their SQL, the training-data subpackage excepted."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("timestamp_queries", "row_queries", "text_queries", "record_queries", "learning_queries", "report_queries", "store_queries")


def collect(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"ledgerloom.plans.{m}"), kind)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return collect("ORACLES")
