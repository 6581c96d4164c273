"""Noisy names and linked pairs, made from hashes: the same rows give the same output on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = ("SQ *", "TST* ", "PAYPAL *", "POS ", "PP*")
PLACES = ("SAN FRANCISCO CA", "NEW YORK NY", "AUSTIN TX", "SEATTLE WA", "ONLINE")


def chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) / 1_000_003


def _pick(values: tuple[str, ...], u: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[F.floor(u * len(values)).cast("int")]


def noisy_name(name: Column, key: Column, prefix: float = 0.4, place: float = 0.3, number: float = 0.3, cut: float = 0.15, seed: int = 1) -> Column:
    """Name as a terminal might print it: acquirer prefix, place, id number, cut-off end, each with its probability."""
    u = lambda i: chance(seed + i, key)
    out = F.upper(F.regexp_replace(F.trim(name), r"\s+", " "))
    out = F.when(u(0) < prefix, F.concat(_pick(PREFIXES, u(1)), out)).otherwise(out)
    out = F.when(u(2) < place, F.concat_ws(" ", out, _pick(PLACES, u(3)))).otherwise(out)
    out = F.when(u(4) < number, F.concat(out, F.lit(" "), (1000 + F.floor(u(5) * 9000)).cast("string"))).otherwise(out)
    return F.when(u(6) < cut, F.rtrim(F.left(out, F.lit(18)))).otherwise(out)


def variants(df: DataFrame, name: str, n: int) -> DataFrame:
    """Up to n different noisy variants of each distinct name."""
    names = df.select(F.col(name).alias("name")).where("trim(name) <> ''").distinct()
    tries = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4 * n))))
    made = tries.select("name", "i", noisy_name(F.col("name"), F.concat_ws("|", "name", F.col("i").cast("string"))).alias("variant"))
    made = made.groupBy("name", "variant").agg(F.min("i").alias("i"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("i", "variant"))), 1, n)
    return made.groupBy("name").agg(first.alias("v")).select("name", F.explode("v.variant").alias("variant"))


def linked_pairs(df: DataFrame, key: str, day: str, amount: str, name: str, seed: int = 3) -> DataFrame:
    """A bank row for every receipt: the day moved by 0, 1 or 2 (55, 35, 10 percent), a tip added to a third, the name noisy; group ids link both."""
    u = lambda i: chance(seed + i, F.col(key))
    shift = F.when(u(0) < 0.55, 0).when(u(0) < 0.9, 1).otherwise(2)
    tip = F.when(u(1) < 0.35, F.round(F.col(amount) * 0.25 * u(2), 2)).otherwise(0.0)
    return df.select(
        F.concat(F.lit("pair_"), F.col(key)).alias("group_id"), F.col(key).alias("receipt_id"), F.concat(F.col(key), F.lit("_b")).alias("bank_id"), F.date_add(day, shift.cast("int")).alias("bank_day"),
        (-F.round(F.col(amount) + tip, 2)).alias("bank_amount"), noisy_name(F.col(name), F.col(key)).alias("bank_name"), F.lit(True).alias("should_match"),
    )
