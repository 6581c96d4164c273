"""Transaction records in comparable form, shared by the operators that look for the same record.

A record takes part in comparisons through two keys. Its *reference* is source
and source_record_id without case, spaces and separators. Its *payment* is
direction, amount in cents, day and the core form of the payee's name. Copies
collapse into their keys before anything is joined, so however often a record
was delivered, it is one reference and one payment. Both are digests of 128
bits, the *nodes* between which links are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ledgerloom.llm import alike
from ledgerloom.llm.names import core, relation
from ledgerloom.runtime import spread

#: Slots of up to so many payments are compared pair by pair, larger ones by the keys of ``alike``: both are complete.
BOUND = 48
PAY = ("dir", "cents", "day", "form")


@F.pandas_udf(StringType())
def name_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict = {}
    for s in batches:
        if len(known) > 1 << 17:
            known.clear()
        yield s.map(lambda x: known[x] if x in known else known.setdefault(x, core(x)))


@F.pandas_udf(BooleanType())
def same_payee(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([a == b or relation(a, b, edits=2) is not None for a, b in zip(x, y)], dtype=bool)


def cents(amount: Column) -> Column:
    """Whole cents; null for null, NaN and infinite amounts."""
    return F.round(amount * 100).try_cast("long")


def direction(c: Column) -> Column:
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n\u00a0"))), F.lit(""))


def digest(*parts: Column) -> Column:
    """128-bit digest of text parts; null if one is null."""
    whole = F.concat(*[F.concat(p.cast("string"), F.lit("\u001f")) for p in parts])
    return F.unhex(F.md5(whole.cast("binary")))


def reference(source: Column, record_id: Column) -> Column:
    """Digest of source and record id without case and separators; null if either is missing."""
    bare = F.nullif(F.regexp_replace(F.lower(record_id), r"[^\p{L}\p{N}]+", ""), F.lit(""))
    return digest(F.lit("r"), source, bare)


def payment(*parts: str) -> Column:
    """Node of a payment, from the columns with its direction, cents, day and form."""
    return digest(F.lit("p"), *[F.col(c) for c in parts])


def keyed(df: DataFrame, *keep: str | Column) -> DataFrame:
    """id, the columns ``keep``, ref, the parts of the payment (dir, cents, day, form) and node.

    The node is the payment's digest or, where a part of it is null, blank or
    no real value (dates that don't parse, amounts that are no number, names
    without letters or digits), the reference's; null if there is neither.
    """
    day = F.datediff(F.col("transaction_date").try_cast("date"), F.lit("1970-01-01").cast("date"))
    ref = reference(F.col("source"), F.col("source_record_id"))
    parts = [direction(F.col("direction")).alias("dir"), cents(F.col("amount")).alias("cents"), day.alias("day"), F.nullif(name_form("merchant_raw"), F.lit("")).alias("form")]
    base = df.select("id", *keep, ref.alias("ref"), *parts)
    pay = payment(*PAY)
    return base.withColumn("node", F.coalesce(pay, "ref")).withColumn("paid", pay.isNotNull())


def payments(rows: DataFrame) -> DataFrame:
    """Distinct payments: node, pay (64 bits of it, to join with) and parts."""
    distinct = rows.where("paid").select(*PAY).distinct().select(payment(*PAY).alias("node"), *PAY)
    return distinct.select("node", F.xxhash64("node").alias("pay"), *PAY)


def probes(new: DataFrame, every: DataFrame) -> DataFrame:
    """The payments ``new`` once for each day within a day of theirs on which ``every`` has others of equal direction and cents.

    ``at`` is that day and ``n`` the number of payments in that slot. A payment
    without company on any of these days is left out here, before anything is
    computed from its name.
    """
    slots = every.groupBy("dir", "cents", F.col("day").alias("at")).agg(F.count("*").alias("n"))
    asked = new.withColumn("at", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)))
    return asked.join(slots, ["dir", "cents", "at"]).where("n > 1 or at <> day")


def slot_pairs(asked: DataFrame, every: DataFrame, bound: int = BOUND) -> DataFrame:
    """Pairs (a < b, as pay) of payments of a slot: all pairs of slots up to ``bound`` payments, alike names of larger ones.

    Whatever names ``confirmed`` accepts, the pair is among them. A slot with
    more payments is never compared pair by pair.
    """
    o = every.select("dir", "cents", F.col("day").alias("at"), F.col("pay").alias("o"))
    few = asked.where(F.col("n") <= bound).join(o, ["dir", "cents", "at"]).where("o <> pay")
    few = few.select(F.least("o", "pay").alias("a"), F.greatest("o", "pay").alias("b"))
    more = hot_pairs(asked.where(F.col("n") > bound), every)
    return few.distinct() if more is None else few.unionByName(more).distinct()


def hot_pairs(hot: DataFrame, every: DataFrame) -> DataFrame | None:
    """Pairs (a < b, as pay) of alike names of the slots that the payments ``hot`` ask for; None if there are no such payments."""
    slots = hot.select("dir", "cents", "at").distinct()
    members = every.join(slots.withColumnRenamed("at", "day"), ["dir", "cents", "day"], "left_semi").select("pay", *PAY)
    members = members.unionByName(hot.select("pay", *PAY)).distinct()
    two = F.explode(F.array(F.floor(F.col("day") / 2) * 2, F.floor((F.col("day") + 1) / 2) * 2 - 1))
    members = members.withColumn("half", two).select(F.xxhash64("dir", "cents", "half").alias("g"), F.col("pay").alias("fid"), "form")
    return None if members.isEmpty() else alike.candidates(members, edits=2)


def crowded(every: DataFrame, bound: int = BOUND) -> DataFrame:
    """The slots (dir, cents, at) that more than ``bound`` payments stand in, with their number n."""
    return every.groupBy("dir", "cents", F.col("day").alias("at")).agg(F.count("*").alias("n")).where(F.col("n") > bound)


def slot_links(new: DataFrame, near: DataFrame | None, hot: DataFrame | None) -> DataFrame:
    """Links (a, b, as nodes) between payments ``new`` and others of slots that aren't among the slots ``hot``, of ``new`` or of those ``near``.

    Every pair is met once and its names are compared where it is met: of two
    new payments the earlier one, or of one day the one with the lesser form,
    looks for the other. ``relation`` may depend on which name comes first; as
    in ``confirmed`` it is that of the lesser pay.
    """
    reach = [F.col("day"), F.col("day") + 1] + [F.col("day") - 1] * (near is not None)
    asked = new.select(*PAY, F.explode(F.array(*reach)).alias("at"))
    if hot is not None:
        asked = asked.join(hot.select("dir", "cents", "at"), ["dir", "cents", "at"], "left_anti")
    there = new.select("dir", "cents", F.col("day").alias("at"), F.col("form").alias("other"), F.lit(True).alias("fresh"))
    if near is not None:
        there = there.unionByName(near.select("dir", "cents", F.col("day").alias("at"), F.col("form").alias("other"), F.lit(False).alias("fresh")))
    met = asked.join(there, ["dir", "cents", "at"]).where("not fresh or at > day or (at = day and form < other)")
    met = met.select("form", "other", payment(*PAY).alias("a"), payment("dir", "cents", "at", "other").alias("b"))
    met = met.select("a", "b", "form", "other", (F.xxhash64("a") < F.xxhash64("b")).alias("first"))
    return met.where(same_payee(F.when(F.col("first"), F.col("form")).otherwise(F.col("other")), F.when(F.col("first"), F.col("other")).otherwise(F.col("form")))).select("a", "b")


def _same(batches):
    for pdf in batches:
        ok = [a == b or relation(a, b, edits=2) is not None for a, b in zip(pdf["fa"], pdf["fb"])]
        yield pdf[ok][["a", "b"]]


def confirmed(pairs: DataFrame, pays: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b, as pay) those that are the same payment, as nodes (a, b).

    Direction and cents are equal, the days at most one apart, and the names
    name the same payee. As all else agrees, two slips of the keyboard are
    allowed, and missing words or initials need not be unambiguous.
    """
    side = lambda x: pays.select(F.col("pay").alias(x), *[F.col(c).alias(x + c) for c in ("node", *PAY)])
    full = pairs.join(side("a"), "a").join(side("b"), "b").where("adir = bdir and acents = bcents and abs(aday - bday) <= 1 and anode <> bnode")
    full = full.select(F.col("anode").alias("a"), F.col("bnode").alias("b"), F.col("aform").alias("fa"), F.col("bform").alias("fb"))
    return spread(full).mapInPandas(_same, "a binary, b binary")


def reference_links(held: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes that hold one reference (ref, node): each to the least of them."""
    several = held.groupBy("ref").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("ref", "a")
    return held.join(several, "ref").where("node <> a").select("a", F.col("node").alias("b")).distinct()
