"""Sinks: exports, appends without repeats, manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.rules import cascade
from ledgerloom.sources.store import SPACES


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the number of files follows the frame's partitions."""
    df.write.mode("overwrite").options(**SPACES).option("header", True).option("escape", '"').csv(path)


def import_lines(df: DataFrame, category: Column) -> DataFrame:
    """Columns of a ledger import: Date, Description, Amount, Payee, Category, Memo."""
    name = F.coalesce("merchant_norm", "merchant_raw", F.lit(""))
    return df.select(F.coalesce("transaction_date", F.lit("")).alias("Date"), F.coalesce("merchant_raw", F.lit("")).alias("Description"), F.col("amount").alias("Amount"), name.alias("Payee"), cascade(category, F.lit("Other Expense")).alias("Category"), F.coalesce("source_record_id", F.lit("")).alias("Memo"))


def audit_lines(df: DataFrame, run_id: str) -> DataFrame:
    """One JSON object per row with inputs, match and decision, for text output."""
    inputs = F.struct(*[c for c in ("source", "source_record_id", "transaction_date", "merchant_raw", "amount", "direction") if c in df.columns])
    match = F.struct(*[c for c in ("matched_transaction_id", "match_score") if c in df.columns])
    final = F.struct(*[c for c in ("category_pred", "category_final", "confidence") if c in df.columns])
    return df.select(F.to_json(F.struct(F.col("id").alias("transaction_id"), F.lit(run_id).alias("run_id"), inputs.alias("inputs"), match.alias("match_scores"), final.alias("final_decision"))).alias("value"))


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the JSON store at ``path`` doesn't have; rows with a null key are always appended."""
    try:
        df = df.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").json(path)


def corpus(df: DataFrame, path: str, label: str, min_rows: int, min_labels: int) -> dict:
    """Write a cleaned corpus as Parquet behind gates on rows, labels and nulls; returns the counts or raises."""
    clean = df.where((F.trim("text") != "") & (F.trim(label) != ""))
    got = clean.agg(F.count("*").alias("rows"), F.countDistinct(label).alias("labels")).first().asDict()
    if got["rows"] < min_rows or got["labels"] < min_labels:
        raise ValueError(f"corpus is too small: {got}")
    clean.write.mode("overwrite").parquet(path)
    return got


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")
