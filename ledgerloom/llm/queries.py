"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("variant_queries", "copy_queries", "incremental_queries", "overlap_queries", "leakage_queries", "mixing_queries", "reading_queries", "split_queries")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    _module = import_module(f"ledgerloom.llm.{_m}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
