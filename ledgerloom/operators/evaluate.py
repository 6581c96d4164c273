"""Evaluation of labels against predictions, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label of either side: support, predicted, tp, precision, recall, f1 (0 where undefined); null labels are a class of their own."""
    c = confusion(df, truth, predicted)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("predicted").alias("plabel")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, t["label"].eqNullSafe(p["plabel"]), "full").select(F.coalesce("label", "plabel").alias("label"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    j = j.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return j.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, macro_f1, weighted_f1, n over the labels of either side."""
    c = per_class(df, truth, predicted)
    return c.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def top_confusions(df: DataFrame, truth: str, predicted: str, n: int) -> DataFrame:
    wrong = confusion(df, truth, predicted).where(~F.col("truth").eqNullSafe(F.col("predicted")))
    return wrong.orderBy(F.desc("n"), F.asc_nulls_last("truth"), F.asc_nulls_last("predicted")).limit(n)


def threshold_sweep(df: DataFrame, truth: str, rule: str, confidence: str, model: str, thresholds: list[float]) -> DataFrame:
    """Accuracy and coverage when the rule holds from each threshold on, below it the model."""
    tried = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    used = F.coalesce(F.col(confidence) >= F.col("threshold"), F.lit(False))
    pick = F.when(used, F.col(rule)).otherwise(F.coalesce(F.col(model), F.col(rule)))
    return tried.groupBy("threshold").agg(F.avg(F.coalesce(pick == F.col(truth), F.lit(False)).cast("double")).alias("accuracy"), F.avg(used.cast("double")).alias("rule_share"))


def sliced(df: DataFrame, dimensions: list[str], hit) -> DataFrame:
    """(dimension, value, n, n_hit) for every dimension in one pass (grouping sets)."""
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("<blank>")).alias("value")) for d in dimensions]))
    return df.select(hit.cast("int").alias("hit"), spread.alias("s")).groupBy("s.dimension", "s.value").agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"))


def ranked(df: DataFrame, by: list[str], order: list, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
