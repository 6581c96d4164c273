"""Double-entry lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def double_entry(df: DataFrame, amount: str, direction: str, account: Column, clearing: str, income: str, keep: list[str]) -> DataFrame:
    """Two lines for every row with a positive amount, in one pass (no join).

    Income debits the clearing account and credits the income account; anything
    else, a null direction too, debits the row's own account and credits the
    clearing account. Null, zero, negative and NaN amounts give no lines.
    """
    earned = F.coalesce(F.lower(F.trim(F.col(direction))) == "income", F.lit(False))
    a = F.col(amount)
    first = F.struct(F.lit(1).alias("line"), F.when(earned, clearing).otherwise(account).alias("account"), a.alias("debit"), F.lit(None).cast("double").alias("credit"))
    second = F.struct(F.lit(2).alias("line"), F.when(earned, income).otherwise(clearing).alias("account"), F.lit(None).cast("double").alias("debit"), a.alias("credit"))
    return df.where((a > 0) & ~F.isnan(a)).select(*keep, F.explode(F.array(first, second)).alias("_l")).select(*keep, "_l.*")
