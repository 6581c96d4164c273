"""Readers: files of many feeds into frames with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import receipts, scalars
from ledgerloom.functions.text import blank_to_null

_KINDS = {"double": T.DoubleType(), "bigint": T.LongType(), "strings": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """Columns separated by blanks, text unless a kind follows a colon."""
    return T.StructType([T.StructField(n, _KINDS.get(k, T.StringType())) for n, _, k in (c.partition(":") for c in text.split())])


CANONICAL = _schema(
    "id source source_record_id transaction_date merchant_raw merchant_norm amount:double currency direction payment_method "
    "category_pred category_final confidence:double matched_transaction_id match_score:double evidence_keys:strings raw_payload tags:strings"
)
STAGING = _schema("rowid:bigint source source_record_id txn_ts amount:double currency merchant_raw description mcc mcc_description category_external subcategory_external raw_payload_json")


def csv_rows(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A CSV file with a header row, every column text; quoted fields may hold line breaks."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)


def canonical(df: DataFrame, source: str, date: str, merchant: str, amount: str, confidence: float, evidence: str, record_id: str | None = None, method: str | None = None, income_from_zero: bool = False) -> DataFrame:
    """Map a feed's text columns to the canonical columns.

    The amount's sign becomes the direction (with ``income_from_zero`` zero and
    missing amounts are 0 and income, otherwise zero is missing); the whole row
    is kept as JSON payload. Rows without an id of their own get a stable one.
    """
    n = scalars.number(F.col(f"`{amount}`"))
    value = F.coalesce(F.abs(n), F.lit(0.0)) if income_from_zero else F.when(n != 0, F.abs(n))
    way = F.when(n < 0, "expense").otherwise("income")
    raw = F.col(f"`{merchant}`")
    own = blank_to_null(F.col(f"`{record_id}`")) if record_id else F.lit(None).cast("string")
    iso = scalars.iso_date(F.col(f"`{date}`"))
    ident = F.coalesce(F.concat(F.lit(f"{source}_"), own), scalars.stable_id(F.lit(source), raw, iso, scalars.money_key(n), way))
    return df.select(
        ident.alias("id"), F.lit(source).alias("source"), own.alias("source_record_id"), iso.alias("transaction_date"), raw.alias("merchant_raw"), F.lit(None).cast("string").alias("merchant_norm"),
        value.alias("amount"), F.lit("USD").alias("currency"), way.alias("direction"), (F.col(f"`{method}`") if method else F.lit(None).cast("string")).alias("payment_method"),
        F.lit(None).cast("string").alias("category_pred"), F.lit(None).cast("string").alias("category_final"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("matched_transaction_id"),
        F.lit(None).cast("double").alias("match_score"), F.array(F.lit(evidence)).alias("evidence_keys"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw_payload"), F.array().cast("array<string>").alias("tags"),
    )


def key_values(text: Column) -> Column:
    """``Key: v; Key: v`` as a map with lower-cased trimmed keys; of repeated keys the last counts."""
    pairs = F.transform(F.split(text, ";"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.when(F.contains(p, F.lit(":")), F.trim(F.substr(p, F.instr(p, ":") + 1))).alias("v")))
    kept = F.filter(pairs, lambda p: (p["k"] != "") & p["v"].isNotNull())
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["k"] == p["k"]))
    return F.map_from_entries(last)


def receipt_texts(spark: SparkSession, path: str) -> DataFrame:
    """Receipt text files: path, sha256 of the bytes, text and the extracted fields."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    f = files.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"))
    t = F.col("text")
    return f.select("*", receipts.merchant_of(t).alias("merchant"), receipts.date_of(t).alias("receipt_date"), receipts.total_of(t).alias("total"), receipts.tax_of(t).alias("tax"), receipts.tip_of(t).alias("tip"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; broken lines are dropped, or end the job if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def nested_records(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One row per element of an array in (multi-line) JSON documents."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def api_staging(df: DataFrame) -> DataFrame:
    """Records of a paged card feed (attributes in capitals) as staging rows: amounts negative, epoch milliseconds to dates."""
    has = {c.upper(): c for c in df.columns}
    pick = lambda *names: F.coalesce(*[F.col(has[n]).cast("string") for n in names if n in has], F.lit(None).cast("string"))
    amount = scalars.number(pick("TRANSACTION_AMOUNT", "AMOUNT"))
    when = pick("TRANSACTION_DATE", "POSTING_DATE")
    iso = F.when(when.rlike(r"^\d{12,13}$"), F.timestamp_millis(when.try_cast("long")).cast("date").cast("string")).otherwise(F.substring(when, 1, 10))
    return df.select(F.lit("dc_pcard").alias("source"), pick("OBJECTID", "ID").alias("source_record_id"), iso.alias("txn_ts"), (-F.abs(amount)).alias("amount"), F.lit("USD").alias("currency"), pick("VENDOR_NAME", "MERCHANT").alias("merchant_raw"), pick("MCC_DESCRIPTION").alias("mcc_description"), F.to_json(F.struct(*df.columns)).alias("raw_payload_json"))
