"""Running sums over a sorted table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import written


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str = "before") -> DataFrame:
    """Add the sum of ``value`` over the rows of the group that come earlier in ``order``.

    ``order`` must be total. Rows are range-partitioned and the partition
    written down; sums run within a partition, and what earlier partitions hold
    is added from a table with one row per partition and group. A group of any
    size is thus spread over as many tasks as its share of the rows.
    """
    ranged = df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    by_part = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_part.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), earlier.alias("_base"))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(base, summed[group].eqNullSafe(base["_group"]) & (summed["_part"] == base["_of"]))
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_of", "_group", "_base", "_in")
