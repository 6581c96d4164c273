import itertools
import random

import pytest

from ledgerloom.llm import alike, variants
from ledgerloom.llm.names import core, relation


def forms_of(spark):
    names = [r.merchant_raw for r in spark.read.parquet("/root/testdata/sf0.01/canonical_records.parquet").select("merchant_raw").distinct().collect()]
    names += [f"stapevegro {c}{v}lmon bakery" for c in "bdfgklmnprstvz" for v in "aeiou"] + ["tsapevegro balmon bakery", "sapevegro bolmon bakery", "stapevegro atelmon bakery"]
    names += ["stapevegrobakery", "tapevegrobakery", "stapevegrobkry", "stapevegrobakeryincorp", "bora bora", "bora bora cafe", "Stapevegro", "Stapevegra", "x" * 5000, "very long " * 400]
    names += [" ".join(f"w{i}rd{j}ab" for j in range(12)) for i in range(3)] + [" ".join(f"w1rd{j}ab" for j in range(11))]
    rng = random.Random(11)
    for n in rng.sample(sorted(filter(None, names)), 250):
        n = list(n[:40])
        for _ in range(rng.choice([1, 2])):
            i = rng.randrange(len(n))
            n[i] = rng.choice(["", n[i] * 2, rng.choice("aeioutrs")])
        names.append("".join(n))
    return {" ".join(sorted(core(n).split(" "))): core(n) for n in names if core(n)}


@pytest.mark.parametrize("edits", [1, 2])
def test_candidates_have_every_alike_pair(spark, edits):
    """All pairs that ``relation`` accepts are candidates (all pairs compared)."""
    forms = forms_of(spark)
    df = spark.createDataFrame([(0, k, f) for k, f in forms.items()], "g long, fid string, form string")
    alike_pairs = {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if relation(forms[a], forms[b], edits)}
    found = {tuple(r) for r in alike.candidates(df, edits, suffixes=edits == 1).collect()}
    assert len(alike_pairs) > 200 and alike_pairs - found == set()


def test_cells_of_a_hot_key_lose_nothing(spark):
    df = spark.createDataFrame([(1, i, 2, s) for i in range(70) for s in (True, False)], "key long, fid long, k int, small boolean")
    assert alike.block_pairs(df, cell=8).count() == 70 * 69 // 2


def test_one_word_names_with_a_slip_at_the_end(spark):
    df = spark.createDataFrame([("Stapevegro",), ("Stapevegra",), ("Zathadotra",)], "merchant_raw string")
    assert {tuple(r) for r in variants.variant_pairs(variants.spellings(df, "merchant_raw")).collect()} == {("Stapevegra", "Stapevegro")}


def test_normalised_names_only_propose(spark):
    rows = [("Stapevegro Bakery", "s")] * 3 + [("Stpvegro Bakery", "s"), ("Zathadotra Fuel Depot", "s"), ("Klechethasham Mfg", None)]
    df = spark.createDataFrame(rows, "merchant_raw string, merchant_norm string")
    assert {tuple(r) for r in variants.variant_pairs(variants.spellings(df, "merchant_raw", "merchant_norm")).collect()} == {("Stapevegro Bakery", "Stpvegro Bakery")}


def test_names_with_a_common_word_and_initial_do_not_all_meet(spark):
    """Equal trade and first letter once made a pair of every short and long token; the order of letters tells them apart."""
    short, long = [f"h{a}{b}{c}" for a in "aeiou" for b in "bdkmp" for c in "aeiou"], [f"h{a}stl{b}gren" for a in "aeiou" for b in "aeiou"]
    forms = [f"{t} manufacturing" for t in short + long] + ["hastl manufacturing"]
    df = spark.createDataFrame([(0, f, f) for f in forms], "g long, fid string, form string")
    wanted = {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if relation(a, b)}
    found = {tuple(r) for r in alike.candidates(df).collect()}
    assert wanted - found == set() and ("hastl manufacturing", "hastlagren manufacturing") in wanted
    mixed = [p for p in found if len(p[0].split(" ")[0]) != len(p[1].split(" ")[0])]
    assert len(mixed) < len(short) * len(long) / 10
