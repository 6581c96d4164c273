"""Lookups of names in stored tables: exact, by containment, learned from earlier decisions, nearest key."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GRAM = 4


def exact(df: DataFrame, key: Column, table: DataFrame, name: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the value of the table's row of that name, null without one; the least value where a name repeats."""
    one = table.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_k")).agg(F.min(value).alias(out))
    return df.withColumn("_k", key).join(one, "_k", "left").drop("_k")


def _grams(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n)))))


def contained(names: DataFrame, name: str, table: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Add ``out``: the value of the first table row (by ``order``) whose key contains the name or is contained in it.

    A text that contains another has the other's first GRAM letters among its
    grams, so this is an equi join on grams of distinct names instead of all
    names against all keys; texts shorter than GRAM join on grams of their own
    length. Null and empty names and keys match nothing.
    """
    n = names.where(F.col(name) != "").select(F.col(name).alias("_n")).distinct()
    t = table.where(F.col(key) != "").select(F.col(key).alias("_t"), F.col(value).alias("_v"), F.col(order).alias("_o"))

    def met(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        first = inner.withColumn("_g", F.left(F.col(i), F.lit(GRAM)))
        every = F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams(F.col(o), k) for k in range(1, GRAM + 1)]))))
        return first.join(outer.withColumn("_g", F.explode(every)), "_g").where(F.contains(F.col(o), F.col(i))).select("_n", "_v", "_o")

    found = met(t, "_t", n, "_n").unionByName(met(n, "_n", t, "_t"))
    best = found.groupBy("_n").agg(F.min_by("_v", F.struct("_o", "_v")).alias(out))
    return names.join(best, names[name] == best["_n"], "left").drop("_n")


def learned(df: DataFrame, decided: DataFrame, keys: dict[str, tuple[Column, Column]], value: str, order: str, out: str) -> DataFrame:
    """Add ``out``: the decision of an earlier row that agrees in one of the keys.

    ``keys`` names each key with its form on both sides, the most trusted first.
    Of several decided rows the first by ``order`` counts. Decisions are reduced
    to one row a key before the join, so a hot key is one row on that side.
    """
    steps = []
    for k, (mine, theirs) in keys.items():
        one = decided.where(F.col(value).isNotNull() & theirs.isNotNull() & (theirs != "")).groupBy(theirs.alias(f"_k{k}")).agg(F.min_by(value, F.struct(order, value)).alias(f"_v{k}"))
        df = df.withColumn(f"_k{k}", mine).join(one, f"_k{k}", "left").drop(f"_k{k}")
        steps.append(f"_v{k}")
    return df.withColumn(out, F.coalesce(*steps)).drop(*steps)


def nearest_key(keys: list[str], least: float = 0.8):
    """Column function: the key equal to a text, else the first that it contains or is contained in, else the nearest by Ratcliff-Obershelp from ``least`` on.

    ``keys`` is a short list (a taxonomy). Case and surrounding space don't
    count; null and blank texts, and texts near to none, give null; of equally
    near keys the first counts.
    """
    folded = [(k.strip().lower(), k) for k in keys]

    def find(text: str | None) -> str | None:
        t = (text or "").strip().lower()
        if not t:
            return None
        near = next((k for f, k in folded if f == t), None) or next((k for f, k in folded if f in t or t in f), None)
        if near:
            return near
        best = max(folded, key=lambda fk: SequenceMatcher(None, t, fk[0]).ratio(), default=None)
        return best[1] if best and SequenceMatcher(None, t, best[0]).ratio() >= least else None

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map({x: find(x) for x in s.dropna().unique()})

    return run
