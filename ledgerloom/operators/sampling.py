"""Deterministic samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.prefix import prefix_sums


def hash_key(seed: int, *cols: str) -> Column:
    """Order key of a seeded shuffle: the md5 of seed and key, the same on every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their key."""
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def stratified_split(df: DataFrame, key: str, label: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Add ``split``: within each label rows in hash order are cut at the shares.

    Places come from prefix sums, so a label of a third of the rows is many tasks.
    """
    hashed = df.withColumn("_h", hash_key(seed, key)).withColumn("_one", F.lit(1))
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_size"))
    placed = prefix_sums(hashed, label, ["_h", key], "_one", "_before")
    df = placed.join(sizes, placed[label].eqNullSafe(sizes["_l"])).withColumn("_p", (F.col("_before") + 0.5) / F.col("_size")).drop("_one", "_before", "_l", "_size")
    names, end, split = list(shares), 1.0, F.lit(None)
    split = F.lit(names[-1])
    bounds, at = [], 0.0
    for s in names[:-1]:
        at += shares[s]
        bounds.append((s, at))
    for s, end in reversed(bounds):
        split = F.when(F.col("_p") < end, s).otherwise(split)
    return df.withColumn("split", split).drop("_h", "_p")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Add ``fold`` 0..k-1, dealt round robin within each label, by prefix sums."""
    hashed = df.withColumn("_h", hash_key(seed, key)).withColumn("_one", F.lit(1))
    return prefix_sums(hashed, label, ["_h", key], "_one", "_before").withColumn("fold", F.col("_before") % k).drop("_h", "_one", "_before")


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each group (dedupe keep-first)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def per_group(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def round_robin(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows taken in turns over the groups, the rarest group first in each turn.

    A limited rank keeps at most n rows a group before anything is sorted as a whole.
    """
    w = Window.partitionBy(by).orderBy(key)
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_size"))
    turns = df.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n)
    sized = turns.join(sizes, turns[by].eqNullSafe(sizes["_by"])).drop("_by")
    return sized.orderBy("_turn", "_size", F.asc_nulls_first(by), key).limit(n).drop("_turn", "_size")


def supported(df: DataFrame, key: str, label: str, least: int, share: float, seeds: tuple[int, int]) -> DataFrame:
    """Add ``split``: test for about ``share`` of the rows by hash, and for the first ``least`` of every label at least; train for the rest.

    ``share`` is rounded down to sixteenths. The first rows of a label are found
    by a limited rank, which drops the others before they are shuffled.
    """
    first = per_group(df.withColumn("_h", hash_key(seeds[0], key)), label, [F.col("_h"), F.col(key)], least).select(key, F.lit(True).alias("_first"))
    drawn = hash_key(seeds[1], key) < F.lit(f"{int(share * 16):x}")
    joined = df.join(first, key, "left")
    return joined.withColumn("split", F.when(F.coalesce("_first", F.lit(False)) | drawn, "test").otherwise("train")).drop("_first")


def locked_split(df: DataFrame, key: str, path: str, seed: int, share: float) -> DataFrame:
    """(key, split): made by hash and stored at ``path`` once, replayed from there ever after.

    A later call with other rows than the stored ones is an error, raised when
    the split is read. ``share`` of the test rows is rounded down to sixteenths.
    """
    from ledgerloom.sources import store

    kind = df.schema[key].dataType.simpleString()
    old = store.read(df.sparkSession, path, f"{key} {kind}, split string")
    if old.isEmpty():
        made = df.select(key, F.when(hash_key(seed, key) < F.lit(f"{int(share * 16):x}"), "test").otherwise("train").alias("split"))
        made.write.mode("overwrite").parquet(path)
        return store.read(df.sparkSession, path, made.schema)
    both = old.join(df.select(key, F.lit(True).alias("_now")), key, "full_outer")
    return store.assert_rows(both, F.col("split").isNull() | F.col("_now").isNull(), "the locked split doesn't match these rows").drop("_now")
