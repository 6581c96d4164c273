"""Connected records: a spanning forest by contraction along minimum edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import Scratch, written


def _swap(df: DataFrame) -> DataFrame:
    return df.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "ea", "eb")


def _jump(to: DataFrame) -> DataFrame:
    return to.join(to.select(F.col("u").alias("p"), F.col("p").alias("g")), "p").select("u", F.col("g").alias("p"))


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", weight: Column | None = None, forest: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Borůvka rounds over a table of links: (labels(node, root), forest(a, b)).

    In each round every node takes its least link (by weight, a hash of the
    pair by default, then by the pair, so no cycle longer than two can arise),
    the smaller node of a mutual pair becomes a root, nodes jump towards the
    root twice, and what remains between different targets is contracted, one
    link a pair. Every round writes its least links, its pointers and its
    remaining links to the shared folder; nothing is gathered on the driver, and
    the tables are deleted when the labels are written. Roots are the least node
    of their component. Nodes without links don't appear; null ends and loops
    are ignored. The forest is left out (None) unless asked for.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y))
    e = e.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), (F.lit(0) if weight is None else weight).alias("w"))
    e = e.groupBy("u", "v").agg(F.min("w").alias("w"))
    if weight is None:
        e = e.withColumn("w", F.xxhash64("u", "v"))
    with Scratch(edges.sparkSession, "forest") as scratch:
        e = scratch.written(e.select("u", "v", "w", F.col("u").alias("ea"), F.col("v").alias("eb")), "links")
        labels = e.select("u", F.col("v").alias("p")).limit(0)
        picks, first = e.select(F.col("ea").alias(a), F.col("eb").alias(b)).limit(0), True
        while not e.isEmpty():
            best = e.unionByName(_swap(e)).groupBy("u").agg(F.min_by(F.struct("v", "ea", "eb"), F.struct("w", "ea", "eb")).alias("m"))
            best = scratch.written(best.select("u", F.col("m.v").alias("p"), F.col("m.ea").alias("ea"), F.col("m.eb").alias("eb")), "least")
            picks = picks.unionByName(best.select(F.col("ea").alias(a), F.col("eb").alias(b)))
            up = best.select(F.col("u").alias("p"), F.col("p").alias("g"))
            mutual = (F.col("g") == F.col("u")) & (F.col("u") < F.col("p"))
            to = best.select("u", "p").join(up, "p").select("u", F.when(mutual, F.col("u")).otherwise(F.col("p")).alias("p"))
            to = scratch.written(_jump(_jump(to)), "pointer")
            step = to.select(F.col("u").alias("p"), F.col("p").alias("g"))
            labels = to if first else labels.join(step, "p", "left").select("u", F.coalesce("g", "p").alias("p"))
            first = False
            pu, pv = to.select("u", F.col("p").alias("nu")), to.select(F.col("u").alias("v"), F.col("p").alias("nv"))
            e = e.join(pu, "u").join(pv, "v").where("nu <> nv")
            e = e.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), F.struct("w", "ea", "eb").alias("m"))
            e = scratch.written(e.groupBy("u", "v").agg(F.min("m").alias("m")).select("u", "v", "m.*"), "links")
        least = labels.groupBy("p").agg(F.min("u").alias("root"))
        labels = written(labels.join(least, "p").select(F.col("u").alias("node"), "root"), "labels")
        kept = written(picks.distinct(), "forest-links") if forest else None
    return labels, kept


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component."""
    return spanning_forest(edges, a, b, forest=False)[0]
