import itertools

from ledgerloom.llm import variants
from ledgerloom.llm.graph import components, spanning_forest
from ledgerloom.llm.names import core, relation


def pairs(spark, names):
    df = spark.createDataFrame([(n, "clash") for n in names], "merchant_raw string, name string")
    return {tuple(r) for r in variants.variant_pairs(variants.spellings(df, "merchant_raw")).collect()}


def test_variants(spark):
    names = ["Stapevegro Bakery", "STAPEVERGO BAKERY", "Bakery, Stapevegro", "stapevegrobakery", "Stapevegro Bkry Inc.", "Other Bakery", None, "", "   ", "--", "Stapevegro Bakery", "Zathadotra Fuel Depot", "x" * 20000]
    one = {"Stapevegro Bakery", "STAPEVERGO BAKERY", "Bakery, Stapevegro", "stapevegrobakery", "Stapevegro Bkry Inc."}
    assert pairs(spark, names) == {(a, b) for a in one for b in one if a < b}


def test_ambiguous_fragments_link_nothing(spark):
    names = ["Nirekleklen Plumbing & Heating", "Platrestegra Plumbing & Heating", "PLUMBING & HEATING", "Margaret Gabrosheshe", "Martha Gabrosheshe", "M. Gabrosheshe", "Harold Pezibeke", "H. Pezibeke"]
    assert pairs(spark, names) == {("H. Pezibeke", "Harold Pezibeke")}


def test_empty(spark):
    assert pairs(spark, []) == set()


def test_blocks_find_what_comparing_all_pairs_finds(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/canonical_records.parquet")
    linked = variants.spellings(rows, "merchant_raw").toPandas()
    payee = dict(zip(linked["name"], linked["payee"]))
    forms = {}
    for n in payee:
        forms.setdefault(" ".join(sorted(core(n).split(" "))), (n, core(n)))
    for (na, fa), (nb, fb) in itertools.combinations(forms.values(), 2):
        if (relation(fa, fb) or ("",))[0] == "strong":
            assert payee[na] == payee[nb], (na, nb)


def test_forest(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "a"), ("hub", "a")] + [("hub", f"n{i:04d}") for i in range(3000)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(200)]
    df = spark.createDataFrame(edges, "a string, b string")
    labels, forest = spanning_forest(df)
    roots = {r.node: r.root for r in labels.collect()}
    assert {roots[n] for n in ("a", "b", "c", "hub", "n0001", "n2999")} == {"a"}
    assert {roots[f"p{i:03d}"] for i in range(201)} == {"p000"} and roots["y"] == "x" and "s" not in roots
    assert forest.count() == len(roots) - len(set(roots.values()))
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
