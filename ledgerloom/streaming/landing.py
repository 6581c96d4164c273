"""Files that keep arriving: the batch operators on a stream, and windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.rows import Feed, classify


def raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records (record_id, feed, raw_text) from Parquet files landing in a folder."""
    return spark.readStream.schema("record_id bigint, feed string, raw_text string").option("maxFilesPerTrigger", 16).parquet(folder)


def judged(stream: DataFrame, feeds: list[Feed]) -> DataFrame:
    """Each record with the reason why it fails, if it does: stateless, so without a watermark."""
    return classify(stream, "raw_text", "feed", feeds)


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` are left out, state is dropped behind it."""
    w = F.window(F.col(ts), window)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def first_deliveries(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
