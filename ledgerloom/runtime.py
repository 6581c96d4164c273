"""Session helpers: reading tables, cutting lineage, intermediate tables and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table of a data folder (a file or a folder of Parquet parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read: the session's ``spark.checkpoint.dir``.

    Only where the session names none (unit tests on one machine) a temporary
    folder is chosen and stored in the session, so that it is set once.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a frame as Parquet at a path and read it back; the lineage is cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back.

    Columnar and compressed, so wide intermediate tables that are read several
    times cost less disk than a row checkpoint; the lineage is cut as well.
    """
    return stored(df, new_path(df.sparkSession, name))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """The frame in as many partitions as the session's shuffles have, whatever its bytes: for Python stages, whose work isn't in the bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def freed(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs, which otherwise stay until the driver happens to collect its garbage."""
    spark.sparkContext._jvm.System.gc()


def remove(path: str) -> None:
    """Delete a folder of intermediate data, on whatever file system it lies."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


class Scratch:
    """Intermediate tables of one operator in one folder, deleted when the ``with`` block ends.

    Results that leave the block are written with ``written`` instead, as lazy
    frames read their tables only later.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.folder)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        return stored(df, f"{self.folder}/{name}-{self.made}")
