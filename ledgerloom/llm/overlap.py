"""The same or nearly the same records in different splits, by similarity-hash fingerprints.

A payment's name form becomes a 64-bit fingerprint, cut into SEGMENTS segments of
about 13 bits. Payments of equal direction and cents, at most a day apart, whose
fingerprints agree in a segment are candidates within RADIUS bits; any two
within SEGMENTS - 1 bits agree in one. Names that are alike can lie further apart
(a name cut off, or written without blanks), so the other pairs of a slot are
candidates too. All candidates are confirmed by the names. Links within one split
are needed beside those across, as chains of records run through them.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import records
from ledgerloom.llm.graph import components
from ledgerloom.llm.names import FULL_NAME
from ledgerloom.runtime import Scratch, spread, written

BITS, RADIUS, SEGMENTS, INITIAL_WEIGHT = 64, 20, 5, 4


def fingerprint(form: str) -> int:
    """Similarity hash of a name form: letter trigrams of its words and, weighing more, their initials; short first names count as the whole ones."""
    features: dict[str, int] = {}
    for word in form.split(" "):
        word = FULL_NAME.get(word, word)
        padded = f"^{word}$"
        for i in range(len(padded) - 2):
            features[padded[i : i + 3]] = features.get(padded[i : i + 3], 0) + 1
        features["#" + word[0]] = features.get("#" + word[0], 0) + INITIAL_WEIGHT
    hashes = np.array([xxhash.xxh64_intdigest(f) for f in features], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").astype(np.int64)
    votes = np.array(list(features.values()), np.int64) @ (2 * bits - 1)
    return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for pdf in batches:
        known: dict = {}
        pdf = pdf.assign(code=[known[f] if f in known else known.setdefault(f, fingerprint(f)) for f in pdf["form"]])
        yield pdf.drop(columns=["form"])


def segments(coded: DataFrame, n: int = SEGMENTS) -> DataFrame:
    """One row per fingerprint and segment: ``n`` segments of nearly equal width."""
    edges = [round(i * BITS / n) for i in range(n + 1)]
    parts = F.array(*[F.shiftrightunsigned("code", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in zip(edges, edges[1:])])
    return coded.select("*", F.posexplode(parts).alias("segment", "value"))


def near_pairs(asked: DataFrame, coded: DataFrame, radius: int = RADIUS, n: int = SEGMENTS, bound: int = records.BOUND) -> DataFrame:
    """Pairs (a < b) of payments of a slot that agree in a segment and lie within ``radius`` bits.

    A segment value that more than ``bound`` payments of a slot have is left
    out: they stand in a slot beyond the bound, where ``records.slot_pairs``
    compares names by exact keys.
    """
    block = lambda df, at: segments(df, n).select(F.xxhash64("dir", "cents", at, "segment", "value").alias("block"), "pay", "code")
    table = block(coded, "day")
    common = table.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("block")
    met = block(asked, "at").join(common, "block", "left_anti").alias("q").join(table.alias("t"), "block").where("q.pay <> t.pay")
    met = met.where(F.bit_count(F.col("q.code").bitwiseXOR(F.col("t.code"))) <= radius)
    return met.select(F.least("q.pay", "t.pay").alias("a"), F.greatest("q.pay", "t.pay").alias("b")).distinct()


def same_record_classes(df: DataFrame, *keep: str) -> DataFrame:
    """All rows (id, keep, node) with ``cls``, the class of their record; null for rows without payment and reference."""
    with Scratch(df.sparkSession, "overlap") as scratch:
        rows = scratch.written(records.keyed(df, *keep), "rows")
        pays = scratch.written(records.payments(rows), "pays")
        asked = records.probes(pays, pays).select("pay", "form", "dir", "cents", "day", "at", "n")
        kinds = "pay long, dir string, cents long, day int, at int, n long, code long"
        asked = scratch.written(asked, "asked")
        coded = spread(asked.select("pay", "dir", "cents", "day", "at", "n", "form")).mapInPandas(_fingerprints, kinds)
        coded = scratch.written(coded, "codes")
        near = near_pairs(coded, coded.select("pay", "dir", "cents", "day", "code").distinct())
        pairs = near.unionByName(records.slot_pairs(asked, pays)).distinct()
        held = rows.where("ref is not null").select("ref", "node").distinct()
        links = records.confirmed(pairs, pays).unionByName(records.reference_links(held))
        roots = components(scratch.written(links, "found"))
        classed = rows.join(roots, "node", "left").withColumn("cls", F.coalesce("root", "node"))
        return written(classed.drop("ref", "root", "paid", *records.PAY), "classed")


def cross_split_pairs(classed: DataFrame, splits: DataFrame, cell: int = 512) -> DataFrame:
    """(id_a < id_b, train_id, eval_id, eval_split, cls) of one record, one row in train and one in validation or test.

    Rows without a split, or of another one, only link others. The pairs of a
    record of many rows are cut into cells of about ``cell`` rows a side.
    """
    placed = classed.where("cls is not null").select("id", "cls").join(splits.where("split in ('train', 'validation', 'test')").select("id", "split"), "id")
    sizes = placed.groupBy("cls").agg(F.count_if(F.col("split") == "train").alias("nt"), F.count_if(F.col("split") != "train").alias("ne"))
    sizes = sizes.where("nt > 0 and ne > 0").select("cls", F.ceil(F.col("nt") / cell).alias("ct"), F.ceil(F.col("ne") / cell).alias("ce"))
    both = placed.join(sizes, "cls")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    train = both.where("split = 'train'").select("cls", F.col("id").alias("train_id"), mine("ct").alias("i"), every("ce").alias("j"))
    held = both.where("split <> 'train'").select("cls", F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), mine("ce").alias("j"), every("ct").alias("i"))
    met = train.join(held, ["cls", "i", "j"])
    return met.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"), "train_id", "eval_id", "eval_split", "cls")


def cross_split_records(classed: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per evaluation row whose record stands in train as well: id, split, cls and the number of its train rows; nothing is paired."""
    placed = classed.where("cls is not null").select("id", "cls").join(splits.select("id", "split"), "id")
    train = placed.where("split = 'train'").groupBy("cls").agg(F.count("*").alias("n_train"))
    return placed.where("split in ('validation', 'test')").join(train, "cls").select("id", "split", "cls", "n_train")
