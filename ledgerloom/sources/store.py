"""A store of records as Parquet: appends, keyed updates, exports read by other tools."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import stored


#: Spark's CSV writer cuts space around values unless told otherwise.
SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store's rows; a store that was never written has none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def updated(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """The rows with the columns of ``changes`` (key, columns) where a change names their key.

    A change sets every one of its columns, to null too; rows without a change
    and rows with a null key stay. Of several changes of a key the greatest by
    all columns counts. Changes to keys that the store doesn't have are ignored.
    """
    cols = [c for c in changes.columns if c != key]
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*cols)).alias("_c"))
    joined = df.join(last, key, "left")
    for c in cols:
        joined = joined.withColumn(c, F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)) if c in df.columns else F.col(f"_c.{c}"))
    return joined.select(*df.columns, *[c for c in cols if c not in df.columns])


def upsert(df: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The store with ``rows`` in place of those of the same key, and the new ones added; rows with a null key are added."""
    kept = df.join(rows.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def merged_payload(payload: Column, added: dict[str, Column]) -> Column:
    """JSON object text with keys added or replaced; anything but an object counts as an empty one."""
    old = F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(*added))
    new = F.create_map(*[x for k, v in added.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_concat(kept, new))


def through_csv(df: DataFrame, path: str) -> DataFrame:
    """The frame written as CSV with a header and read back as text, as another tool sees it; null and empty are both null then."""
    df.write.mode("overwrite").options(**SPACES).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    schema = ", ".join(f"`{c}` string" for c in df.columns)
    return df.sparkSession.read.schema(schema).options(**SPACES).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def through_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def payloads(df: DataFrame, name: str, key: str, columns: list[str], hex_digits: int = 2) -> DataFrame:
    """(batch_name, count, payload): rows as JSON documents of a bounded number of transactions.

    Rows are dealt to 16 ** ``hex_digits`` batches by the md5 of their key; take
    as many digits as make a batch small enough for the receiver.
    """
    batch = F.concat(F.lit(name + "-"), F.substr(F.md5(F.col(key)), F.lit(1), F.lit(hex_digits)))
    one = df.where(F.col(key).isNotNull()).groupBy(batch.alias("batch_name")).agg(F.count("*").alias("count"), F.collect_list(F.struct(*columns)).alias("transactions"))
    return one.select("batch_name", "count", F.to_json(F.struct("batch_name", "count", "transactions")).alias("payload"))


def bundle(parts: dict[str, DataFrame], folder: str, run_id: str) -> DataFrame:
    """Write several exports under one run id; (export, rows, run_id) of what was written."""
    out = None
    for name, df in parts.items():
        back = stored(df.withColumn("run_id", F.lit(run_id)), f"{folder}/{run_id}/{name}")
        one = back.agg(F.count("*").alias("rows")).select(F.lit(name).alias("export"), "rows", F.lit(run_id).alias("run_id"))
        out = one if out is None else out.unionByName(one)
    return out


def run_index(spark: SparkSession, path: str, config: dict, inputs: DataFrame, outputs: list[str]) -> DataFrame:
    """One JSON document per run: its settings, the hashes of its inputs (path, bytes, sha256) and its outputs."""
    files = [r.asDict() for r in inputs.orderBy("path").collect()]
    text = json.dumps({"config": config, "inputs": files, "outputs": outputs}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path)


def assert_rows(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The frame, failing at run time if a row is ``bad``."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
