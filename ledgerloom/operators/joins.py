"""Scored range joins and null-aware anti joins."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.functions.scalars import closeness
from ledgerloom.operators.matching import best_in_cells

LEAST_RATIO = 0.7


def _ratio(x: str | None, y: str | None, least: float) -> float:
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    m = SequenceMatcher(None, x, y)
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return 0.0
    r = m.ratio()
    return r if r >= least else 0.0


def equal_names(a: Column, b: Column) -> Column:
    """1 for equal names, 0 for others and nulls."""
    return F.when(a == b, 1.0).otherwise(0.0)


def floored_ratio(a: Column, b: Column, least: float = LEAST_RATIO) -> Column:
    """Ratcliff-Obershelp ratio of two texts, 0 below ``least`` and for null or empty texts.

    Upper bounds of the ratio, from lengths and letter counts, spare most
    comparisons; equal pairs of a batch are compared once.
    """

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[k] if k in known else known.setdefault(k, _ratio(*k, least)) for k in zip(x, y)], dtype=float)

    return run(a, b)


def text_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts; null or empty gives 0."""
    return floored_ratio(a, b, 0.0)


def best_match(left: DataFrame, right: DataFrame, similarity, days: int = 3, tolerance: float = 10.0, weights: tuple[float, float, float] = (0.3, 0.5, 0.2), least: float = 0.75) -> DataFrame:
    """(left_id, right_id, score): for each left row its best right row by date, amount and name.

    Both sides have (id, day date, amount, name, rank). Dates must be less than
    ``days`` apart and amounts less than ``tolerance``. ``similarity`` (0 to 1)
    is a function of two name columns. The highest score wins, ties go to the
    lower right rank. Left rows without a match, or with one below ``least``, appear
    with a null right_id (and the best score, 0 without candidates). Right rows
    with a null id can win, and then give a null right_id too.

    ``equal_names`` and ``floored_ratio`` are searched in cells (``matching``),
    without listing all pairs. For other similarities left rows are exploded to
    the days around theirs and to three steps of ``tolerance`` around their
    amount, so the join is an equi join on day and step, and the similarity is
    asked only for candidates that could still win: those whose score without
    the name is within its weight of the left row's best.
    """
    if similarity in (equal_names, floored_ratio):
        ratio = (lambda x, y: _ratio(x, y, LEAST_RATIO)) if similarity is floored_ratio else None
        return best_in_cells(left, right, ratio, LEAST_RATIO, days, tolerance, weights, least)
    a = left.select(F.col("id").alias("left_id"), F.col("day").alias("left_day"), F.col("amount").alias("left_amount"), F.col("name").alias("left_name"), F.col("rank").alias("left_rank"))
    b = right.select(F.col("id").alias("right_id"), F.col("day").alias("right_day"), F.col("amount").alias("right_amount"), F.col("name").alias("right_name"), F.col("rank").alias("right_rank"))
    step = F.floor(F.col("left_amount") / tolerance)
    near = a.withColumn("right_day", F.explode(F.sequence(F.date_sub("left_day", days - 1), F.date_add("left_day", days - 1))))
    near = near.withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
    b = b.withColumn("step", F.floor(F.col("right_amount") / tolerance))
    met = near.join(b, ["right_day", "step"]).where(F.abs(F.col("left_amount") - F.col("right_amount")) < tolerance)
    dates = closeness(F.datediff("left_day", "right_day"), float(days))
    amounts = closeness(F.col("left_amount") - F.col("right_amount"), tolerance)
    met = met.withColumn("_base", weights[0] * dates + weights[1] * amounts)
    most = F.max("_base").over(Window.partitionBy("left_id", "left_rank"))
    met = met.withColumn("_most", most).where(F.col("_base") + weights[2] + 1e-9 >= F.col("_most"))
    met = met.withColumn("score", F.col("_base") + weights[2] * similarity(F.col("left_name"), F.col("right_name")))
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("left_id", "left_rank").orderBy(F.desc("score"), "right_rank"))).where("_n = 1")
    best = best.select("left_rank", F.when(F.col("score") >= least, F.col("right_id")).alias("right_id"), "score")
    out = a.select("left_id", "left_rank").join(best, "left_rank", "left")
    return out.select("left_id", "right_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def not_in(df: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is NOT IN the others' keys with SQL's null rules.

    Null keys are kept only if there are no others at all; a null among the
    others leaves nothing. Callers that want nulls ignored filter them first.
    An anti join on the distinct keys, which is shuffled if they are many (a
    NOT IN subquery always broadcasts them), and one aggregated row on whether
    there are others and nulls among them.
    """
    o = others.select(F.col(other_key).alias("_k"))
    state = o.agg(F.count("*").alias("_n"), F.count_if(F.col("_k").isNull()).alias("_nulls"))
    left = df.join(o.where("_k is not null").distinct(), F.col(key) == F.col("_k"), "left_anti")
    none = (F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())
    return left.join(F.broadcast(state), F.lit(True)).where(none).drop("_n", "_nulls")


def replayed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a persisted list of ids."""
    return df.join(ids.select(key), key, "left_semi")
