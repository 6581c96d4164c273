"""Records that differ only in writing, collapsed with the number of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.records import cents, direction
from ledgerloom.runtime import written

RAW = ("source", "transaction_date", "merchant_raw", "amount", "direction")


def word_key(text: Column) -> Column:
    """The words of a text, runs of letters or digits, without case and order ('' if there are none)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def raw_groups(df: DataFrame) -> DataFrame:
    """Byte-identical rows (in the five columns that count) collapsed: their least id and number."""
    return df.groupBy(*RAW).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def canonical_groups(raw: DataFrame) -> DataFrame:
    """The distinct survivors with their canonical key; rows that can't have copies keep a null key."""
    amount, way = cents(F.col("amount")), direction(F.col("direction"))
    key = F.when(amount.isNotNull() & way.isNotNull(), F.struct("source", "transaction_date", word_key(F.col("merchant_raw")).alias("words"), amount.alias("cents"), way.alias("way")))
    return raw.withColumn("key", key)


def collapse(df: DataFrame) -> DataFrame:
    """One row per record: id (least), source, transaction_date, words, cents, direction, n_copies.

    Copies have equal source and transaction_date (null equals null), the same
    words in merchant_raw, the same cents and the same direction but for case
    and surrounding space. Null, NaN and infinite amounts and null or blank
    directions have no copies: each such row stays its own record with 1 copy.
    Byte-identical rows are counted first (partial counts before the shuffle),
    only distinct survivors are canonicalised, then the counts are summed.
    """
    survivors = canonical_groups(raw_groups(df))
    one = survivors.where("key is not null").groupBy("key").agg(F.min("first_id").alias("id"), F.sum("n").alias("n_copies"))
    one = one.select("id", "key.source", "key.transaction_date", "key.words", "key.cents", F.col("key.way").alias("direction"), "n_copies")
    lone = canonical_groups(df.withColumn("first_id", F.col("id")).withColumn("n", F.lit(1).cast("long"))).where("key is null")
    lone = lone.select("id", "source", "transaction_date", word_key(F.col("merchant_raw")).alias("words"), cents(F.col("amount")).alias("cents"), direction(F.col("direction")).alias("direction"), F.col("n").alias("n_copies"))
    return one.unionByName(lone)


def copy_pairs(df: DataFrame) -> DataFrame:
    """(id_a, id_b) for every copy beyond the first: id_a is the least id of its record.

    Survivors are canonicalised once and written; only rows of raw groups that belong to a record of several rows are joined back.
    """
    survivors = written(canonical_groups(raw_groups(df)).where("key is not null"), "survivors")
    least = survivors.groupBy("key").agg(F.min("first_id").alias("id_a"), F.sum("n").alias("n")).where("n > 1").select("key", "id_a")
    of_raw = survivors.join(least, "key").select("id_a", *[F.col(c).alias(f"_{c}") for c in RAW])
    same = None
    for c in RAW:
        this = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = this if same is None else same & this
    return df.select("id", *RAW).join(of_raw, same).where("id <> id_a").select("id_a", F.col("id").alias("id_b"))
