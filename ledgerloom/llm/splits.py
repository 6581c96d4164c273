"""Train, validation and test splits that keep related records together.

Records and the keys they carry form a graph; a spanning forest over the keys
(Borůvka contraction, graph.spanning_forest) gives every record the root of its
group, and is kept so that later records can be joined to it. Roots are dealt to
the splits by size band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import spanning_forest
from ledgerloom.llm.prefix import prefix_sums
from ledgerloom.runtime import Scratch, stored, written

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
CYCLE, BINS = 20, 1000
LABELS, SPLIT = "node string, root string, n int", "root string, split string"


def _with_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.withColumn("_keys", F.array_distinct(F.array_compact(F.array(*keys)))).withColumn("_key", F.coalesce(F.get("_keys", F.lit(0)), F.lit("")))


def _links(rows: DataFrame) -> DataFrame:
    sets = rows.where(F.size("_keys") > 1).select("_keys").distinct()
    return sets.select(F.col("_keys")[0].alias("a"), F.explode(F.slice("_keys", F.lit(2), F.size("_keys") - 1)).alias("b"))


def rooted(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with ``root``, labels(node, root), forest(a, b)): rows that share a key, directly or through others, have one root.

    Rows are collapsed to their distinct sets of keys first, so a key that
    stands in a third of all rows is a few links. Rows with no key at all share
    the root ''.
    """
    rows = _with_keys(df, keys)
    labels, forest = spanning_forest(_links(rows))
    rows = rows.join(labels.select(F.col("node").alias("_key"), F.col("root").alias("_root")), "_key", "left")
    return rows.withColumn("root", F.coalesce("_root", "_key")).drop("_keys", "_key", "_root"), labels, forest


def deal(groups: DataFrame, shares: dict[str, float] = SPLITS, seed: int = 11) -> DataFrame:
    """(root, split) for groups (root, size).

    Groups are put into bands by powers of two of their size. In a band they lie
    in the order of a seeded hash; the middle of each on the running sum of
    sizes, taken in cycles of about CYCLE groups, is its phase. From the largest
    band down, the phases are divided among the splits in proportion to what
    these still lack of their shares of all rows, so what a band of few large
    groups can't give exactly, the smaller ones make up. The driver gets one
    number per band and thousandth of a cycle.
    """
    names = list(shares)
    with Scratch(groups.sparkSession, "deal") as scratch:
        banded = scratch.written(groups.withColumn("band", F.floor(F.log2("size")).cast("int")), "bands")
        stats = banded.groupBy("band").agg((F.sum("size") / F.count("*") * CYCLE).alias("cycle"))
        running = prefix_sums(banded.withColumn("draw", F.xxhash64(F.lit(seed), "root")), "band", ["draw", "root"], "size")
        phase = (F.col("before") + F.col("size") / 2) / F.col("cycle")
        placed = running.join(F.broadcast(stats), "band").withColumn("bin", F.floor((phase - F.floor(phase)) * BINS).cast("int"))
        placed = scratch.written(placed.select("root", "size", "band", "bin"), "bins")
        bins = sorted((-r.band, r.bin, r.rows) for r in placed.groupBy("band", "bin").agg(F.sum("size").alias("rows")).collect())
        lacking = {s: shares[s] * sum(rows for _, _, rows in bins) for s in names}
        cuts = []
        for band in sorted({b for b, _, _ in bins}):
            inside = [(i, rows) for b, i, rows in bins if b == band]
            whole, wanted = sum(rows for _, rows in inside), sum(max(0.0, v) for v in lacking.values()) or 1.0
            ends, at = [], 0.0
            for s in names:
                at += max(0.0, lacking[s]) / wanted * whole
                ends.append((s, at))
            before = 0
            for i, rows in inside:
                split = next((s for s, end in ends if before + rows / 2 < end), ends[-1][0])
                cuts.append((-band, i, split))
                lacking[split] -= rows
                before += rows
        cut = groups.sparkSession.createDataFrame(cuts, "band int, bin int, split string")
        return written(placed.join(F.broadcast(cut), ["band", "bin"]).select("root", "split"), "dealt")


def assign(df: DataFrame, keys: list[Column], shares: dict[str, float] = SPLITS, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with root and split, forest). Clashing columns root and split of the input are replaced.

    With ``folder``, labels, forest and splits are kept there for ``attach``.
    """
    rows, labels, forest = rooted(df.drop("root", "split"), keys)
    rows = written(rows, "rooted")
    dealt = deal(rows.groupBy("root").agg(F.count("*").alias("size")), shares)
    if folder:
        stored(labels.withColumn("n", F.lit(0)), f"{folder}/labels/n0")
        stored(forest, f"{folder}/forest/n0")
        stored(dealt, f"{folder}/splits/n0")
    return rows.join(dealt, "root"), forest


def attach(df: DataFrame, keys: list[Column], folder: str, shares: dict[str, float] = SPLITS, n: int = 1) -> DataFrame:
    """Later rows with root, split and ``conflict``, joined to the kept forest; ``n`` numbers the call, from 1.

    Rows tied to records that have a split go there; a group of new records only
    is dealt anew. Records once dealt never move, so where new rows tie groups
    of different splits together, they go to that of the least root and
    ``conflict`` is true. Only groups that the new keys hit are read.
    """
    spark = df.sparkSession
    labels = spark.read.schema(LABELS).parquet(*[f"{folder}/labels/n{i}" for i in range(n)])
    splits = spark.read.schema(SPLIT).parquet(*[f"{folder}/splits/n{i}" for i in range(n)])
    rows = _with_keys(df.drop("root", "split", "conflict"), keys)
    held = rows.select(F.explode(F.when(F.size("_keys") > 0, F.col("_keys")).otherwise(F.array(F.lit("")))).alias("node")).distinct()
    known = held.join(labels, "node", "left").groupBy("node").agg(F.max_by("root", "n").alias("root")).withColumn("root", F.coalesce("root", "node"))
    found, forest = spanning_forest(_links(rows).unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    comp = written(known.join(found.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "root")), "attached")
    old = comp.join(splits, "root").groupBy("comp").agg(F.min_by("split", "root").alias("split"), F.min("root").alias("root"), (F.count_distinct("split") > 1).alias("conflict"))
    rows = rows.join(comp.select(F.col("node").alias("_key"), "comp"), "_key").join(old, "comp", "left")
    rows = written(rows.withColumn("root", F.coalesce("root", "comp")).drop("_keys", "_key", "comp"), "attached-rows")
    dealt = deal(rows.where("split is null").groupBy("root").agg(F.count("*").alias("size")), shares)
    stored(comp.join(old.select("comp", F.col("root").alias("of")), "comp", "left").select("node", F.coalesce("of", "comp").alias("root"), F.lit(n).alias("n")), f"{folder}/labels/n{n}")
    stored(forest, f"{folder}/forest/n{n}")
    stored(dealt, f"{folder}/splits/n{n}")
    rows = rows.join(dealt.withColumnRenamed("split", "_new"), "root", "left")
    return rows.withColumn("split", F.coalesce("split", "_new")).withColumn("conflict", F.coalesce("conflict", F.lit(False))).drop("_new")


def entity_keys(norm: Column, source: Column) -> list[Column]:
    """Keys of a record: merchant_norm as stored and without case and surrounding space, or else its source."""
    bare = F.lower(F.btrim(norm, F.lit(" \t\r\n\u00a0")))
    has = norm.isNotNull() & (bare != "")
    return [F.when(has, F.concat(F.lit("n|"), bare)), F.when(has, F.concat(F.lit("s|"), norm)), F.when(~has | norm.isNull(), F.concat(F.lit("o|"), F.coalesce(source, F.lit(""))))]
