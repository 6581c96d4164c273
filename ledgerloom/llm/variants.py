"""Variant spellings of names: suffix blocking and comparison by longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.llm import alike
from ledgerloom.llm.graph import components
from ledgerloom.llm.names import STRONG, WEAK, core, relation
from ledgerloom.runtime import Scratch, freed, spread, written


@F.pandas_udf(StringType())
def core_form(s: pd.Series) -> pd.Series:
    return s.map(core)


def _related(batches):
    for pdf in batches:
        found = [relation(a, b, 2 if same else 1) for a, b, same in zip(pdf["fa"], pdf["fb"], pdf["same"])]
        pdf = pdf.assign(kind=[f and f[0] for f in found], firm=[f[1] if f else 0 for f in found])
        yield pdf[pdf["kind"].notna()][["a", "b", "fa", "fb", "kind", "firm"]]


def candidate_pairs(forms: DataFrame) -> DataFrame:
    """Pairs (a < b) of forms (fid, form) to be compared: none that ``relation`` accepts is missing.

    The dictionary of all tokens is indexed by suffix, overly common suffixes
    are refined by other properties of the token before any are discarded, and
    tokens shortened by a letter find the rest. Forms then meet through the
    rarest token of the form with fewer tokens (alike.candidates).
    """
    return alike.candidates(forms.select(F.lit(0).cast("long").alias("g"), "fid", "form"), 1, suffixes=True)


def norm_pairs(forms: DataFrame, norms: DataFrame) -> DataFrame:
    """Pairs (a < b): a form and the most frequent form that has the same normalised name (norms: fid, norm, n).

    The normalised name is often wrong or missing, so it only proposes pairs.
    """
    main = norms.groupBy("norm").agg(F.max_by("fid", F.struct("n", "fid")).alias("main"))
    pairs = norms.join(main, "norm").where("fid <> main")
    return pairs.select(F.least("fid", "main").alias("a"), F.greatest("fid", "main").alias("b")).distinct()


def link_forms(forms: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """(fid, payee) for forms (fid, form): payee is the least fid of those that name the same.

    Strong relations are joined by contraction. A weak one (tokens missing, or
    an initial) joins a form's component to that of the best-matching longer
    forms, with the most letters in equal tokens, then the fewest tokens, only
    if all these are of one component. Two slips of the keyboard are accepted
    where the normalised names agree (``norms``).
    """
    with Scratch(forms.sparkSession, "forms") as scratch:
        tried = candidate_pairs(forms).withColumn("same", F.lit(False))
        if norms is not None:
            tried = tried.unionByName(norm_pairs(forms, norms).withColumn("same", F.lit(True)))
        tried = tried.groupBy("a", "b").agg(F.max("same").alias("same"))
        fa, fb = forms.select(F.col("fid").alias("a"), F.col("form").alias("fa")), forms.select(F.col("fid").alias("b"), F.col("form").alias("fb"))
        full = tried.join(fa, "a").join(fb, "b").select("a", "b", "fa", "fb", "same")
        kind = forms.schema["fid"].dataType.simpleString()
        links = scratch.written(spread(full).mapInPandas(_related, f"a {kind}, b {kind}, fa string, fb string, kind string, firm int"), "relations")
        freed(forms.sparkSession)
        comps = components(links.where(F.col("kind") == STRONG))
        all_forms = forms.select("fid").join(comps.withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("root", "fid").alias("root"))
        all_forms = scratch.written(all_forms, "strong")
        weak = links.where(F.col("kind") == WEAK)
        size = lambda c: F.size(F.split(c, " "))
        letters = lambda c: F.length(F.replace(F.col(c), F.lit(" ")))
        smaller = (size("fa") < size("fb")) | ((size("fa") == size("fb")) & (letters("fa") < letters("fb")))
        weak = weak.select(
            F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("small"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("large"),
            F.struct(-F.col("firm"), F.greatest(size("fa"), size("fb"))).alias("k"),
        )
        weak = weak.join(all_forms.select(F.col("fid").alias("large"), F.col("root").alias("to")), "large")
        weak = weak.join(all_forms.select(F.col("fid").alias("small"), F.col("root").alias("from")), "small").where("from <> to")
        fewest = weak.groupBy("small").agg(F.min("k").alias("k"))
        firm = weak.join(fewest, ["small", "k"]).groupBy("small", "from").agg(F.min("to").alias("to"), F.max("to").alias("to2"))
        joined = components(firm.where("to = to2").select(F.col("from").alias("a"), F.col("to").alias("b")))
        roots = all_forms.join(joined.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
        return written(roots.select("fid", F.coalesce("over", "root").alias("payee")), "payees")


def spellings(df: DataFrame, name: str, norm: str | None = None) -> DataFrame:
    """(name, n, payee) of every distinct spelling that is not null or blank; ``norm`` names a column of normalised names.

    Rows are counted per spelling first, spellings per core form next, so a
    name that stands in a third of all rows is one row from the first
    aggregation on. Names without letters or digits are each on their own.
    """
    cols = [F.col(name).alias("name"), (F.lit(None).cast("string") if norm is None else F.col(norm)).alias("norm")]
    raw = df.select(*cols).where("trim(name) <> ''").groupBy("name", "norm").agg(F.count("*").alias("n"))
    with Scratch(df.sparkSession, "spellings") as scratch:
        counted = scratch.written(raw, "rows")
        named = counted.groupBy("name").agg(F.sum("n").alias("n")).withColumn("form", core_form("name"))
        by_tokens = F.array_join(F.array_sort(F.split("form", " ")), " ")
        named = written(named.withColumn("fkey", F.when(F.col("form") == "", F.concat(F.lit("\u0000"), F.col("name"))).otherwise(by_tokens)), "names")
        forms = named.where("form <> ''").groupBy("fkey").agg(F.max_by("form", F.struct("n", "form")).alias("form"))
        forms = scratch.written(forms.withColumn("fid", F.monotonically_increasing_id()), "forms")
        norms = None
        if norm is not None:
            known = counted.where("trim(norm) <> ''").withColumn("norm", F.lower(F.btrim("norm")))
            known = known.join(named.select("name", "fkey"), "name").join(forms.select("fid", "fkey"), "fkey")
            norms = known.groupBy("fid", "norm").agg(F.sum("n").alias("n"))
        payees = link_forms(forms.select("fid", "form"), norms)
        least = forms.join(payees, "fid")
        least = least.join(least.groupBy("payee").agg(F.min("fkey").alias("least")), "payee").select("fkey", F.col("least").alias("payee"))
        least = written(least, "payee-of")
    return named.join(least, "fkey", "left").select("name", "n", F.coalesce("payee", "fkey").alias("payee"))


def variant_pairs(linked: DataFrame, cell: int = 512) -> DataFrame:
    """(name_a < name_b) of each payee; the pairs of a payee of many names are cut into cells of about ``cell`` names."""
    sizes = linked.groupBy("payee").agg(F.count("*").alias("names")).where("names > 1").select("payee", F.ceil(F.col("names") / cell).alias("cells"))
    several = linked.select("payee", "name").join(sizes, "payee").withColumn("mine", F.pmod(F.xxhash64("name"), F.col("cells")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    left = several.select("payee", F.col("name").alias("name_a"), F.col("mine").alias("i"), every.alias("j"))
    right = several.select("payee", F.col("name").alias("name_b"), F.col("mine").alias("j"), every.alias("i"))
    return left.join(right, ["payee", "i", "j"]).where("name_a < name_b").select("name_a", "name_b")
