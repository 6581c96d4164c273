"""Numbers, dates, JSON and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Number of a text with optional $ and thousands commas; anything else is null."""
    bare = F.regexp_replace(F.trim(c), r"[$,]", "")
    return F.when(bare.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), bare.try_cast("double"))


def signed_direction(amount: Column) -> Column:
    return F.when(amount < 0, "expense").otherwise("income")


def inferred_direction(direction: Column, amount: Column, category: Column) -> Column:
    """The stated direction, else that of a negative amount, else of the category."""
    stated = F.lower(F.trim(direction))
    return F.when(stated.isin("expense", "income"), stated).when(amount < 0, "expense").when(F.lower(category) == "income", "income").otherwise("expense")


def closeness(distance: Column, tolerance: float) -> Column:
    """1 at no distance, falling linearly to 0 at the tolerance and beyond; null distance gives 0."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(distance) / tolerance), F.lit(0.0))


def confidence_bin(c: Column, edges: tuple[float, ...] = (0.5, 0.7, 0.85)) -> Column:
    out = F.when(c.isNull(), "missing")
    lower = None
    for e in edges:
        out = out.when(c < e, f"<{e:.2f}" if lower is None else f"{lower:.2f}-{e:.2f}")
        lower = e
    return out.otherwise(f">={lower:.2f}")


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd of an ISO or month/day/year text; other texts stay as they are."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10).try_cast("date"))
    us = F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(c, "M/d/yyyy"))
    return F.coalesce(F.coalesce(iso, us).cast("string"), c)


def json_text(c: Column, field: str) -> Column:
    """Text of a top-level field; invalid JSON, JSON null and blank values give null."""
    return F.nullif(F.trim(F.get_json_object(c, f"$.{field}")), F.lit(""))


def money_key(amount: Column) -> Column:
    return F.coalesce(F.abs(amount).cast("decimal(18,2)").cast("string"), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """``hash_`` and 16 hex digits of the SHA-1 over the parts, nulls as ''."""
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit("hash_"), F.substring(F.sha1(joined), 1, 16))


def fingerprint(*parts: Column) -> Column:
    return F.lower(F.concat_ws("\t", *[F.coalesce(p, F.lit("")) for p in parts]))
