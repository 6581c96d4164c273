import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import leakage, mixing, prefix, reading

ITEM = "A village radio station without advertisers gives Drastevelar Forge a hamper valued at 1744.28 instead of wages but half of the sum belongs to a raffle fund"


def leaks(spark, docs, items=((1, ITEM), (2, None), (3, ""), (4, "short one"))):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, words string, print int")
    e = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", e, "item_id").collect()}


def test_leaks(spark):
    w = ITEM.split()
    filler = "the owner asked the seller for a refund because the store had no paper "
    docs = [
        (1, filler + ITEM + filler), (2, ITEM.upper().replace(" ", "\n")), (3, "<p>" + "</p> <b>".join(w[:20]) + "</b>"), (4, filler * 3 + " ".join(w[:9]) + filler), (5, " ".join(x if i % 6 else "changed" for i, x in enumerate(w))),
        (6, " ".join(w[:14]) + " page 4 of 9 " + " ".join(w[14:])), (7, " ".join(w[::-1])), (8, None), (9, ""), (10, "word " * 200_000 + ITEM), (11, ITEM), (12, "x" * 1_000_000), (13, "gives Drasteve-\nlar Forge a hamper valued at 1744.28 instead of wages but half of the sum belongs"),
        (14, " ".join(w[:8]) + " " + filler * 30 + " ".join(w[8:16])),
    ]
    assert {d for d, i in leaks(spark, docs)} == {1, 2, 3, 5, 6, 10, 11, 13}
    assert leaks(spark, []) == set() and leaks(spark, docs[:1], [(1, None)]) == set()


def test_winnowing_keeps_one_of_every_window():
    words = [f"w{i % 37}" for i in range(400)]
    for k, window in ((3, 2), (2, 4), (5, 1)):
        prints, at = leakage.winnow(words, k, window)
        assert set(np.diff(at)) <= set(range(1, window + 1)) and at[0] < window and at[-1] > 400 - k - window
    shared = [f"s{i}" for i in range(4)]
    a, b = leakage.winnow([f"a{i}" for i in range(9)] + shared + ["x", "y"])[0], leakage.winnow(["p", "q", "r"] + shared + [f"b{i}" for i in range(7)])[0]
    assert set(a) & set(b)
    assert len(leakage.winnow(["one", "two"])[0]) == 0 and len(leakage.winnow(["one", "two", "three"])[0]) == 1


def test_leaks_against_brute_force(spark):
    import re
    from difflib import SequenceMatcher

    root = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, "doc_id", items, "item_id").collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sure = set()
    texts = [(r.item_id, words(r.text)) for r in items.collect()]
    for d in docs.collect():
        doc = words(d.text)
        for i, item in texts:
            m = SequenceMatcher(None, doc, item, autojunk=False).find_longest_match()
            if m.size >= len(item) / 2:
                sure.add((d.doc_id, i))
    assert sure <= got and sure


def test_prefix_sums(spark):
    df = spark.createDataFrame([("hot", i, i % 7) for i in range(5000)] + [("b", 1, 4), (None, 1, 5), (None, 2, 6)], "g string, k int, v long").repartition(9)
    got = {(r.g, r.k): r.before for r in prefix.prefix_sums(df, "g", ["k"], "v").collect()}
    assert len(got) == 5003 and got["b", 1] == 0 and got[None, 2] == 5
    total = 0
    for i in range(5000):
        assert got["hot", i] == total
        total += i % 7


def test_mixture(spark):
    docs = [(i, f"text number {i} with some words", ["a", "b", "c", None][i % 4]) for i in range(400)] + [(1000, None, "a"), (1001, "", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.2, 0), ("missing", 0.1, 2), ("null", None, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mixture(d, "doc_id", t)
    s = {r.source: r for r in shares.collect()}
    largest = max(r.tokens for r in drawn.collect())
    for x in ("a", "b"):
        assert s[x].budget - largest <= s[x].drawn_tokens <= s[x].budget
    assert s["a"].most_times in (2, 3) and s["c"].drawn_tokens == s["missing"].drawn_tokens == s["null"].drawn_tokens == 0
    assert sum(r.tokens * r.times for r in drawn.where("source = 'a'").collect()) == s["a"].drawn_tokens
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    drawn, shares = mixing.mixture(empty, "doc_id", t)
    assert drawn.count() == 0 and shares.count() == 5


def test_token_counts(spark):
    import base64

    import tiktoken

    path = f"{mixing.TOKENIZERS}/{mixing.RANKS}"
    enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    texts = ["Hello world, it's 2024!", "", None, "<|endoftext|>", "a" * 100_000, "é ü 日本"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df, "doc_id").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_reading_levels_on_held_out_documents(spark):
    root = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{root}/documents.parquet").where("lang = 'en' and source <> 'receipt_ocr'")
    labels = spark.read.parquet(f"{root}/reading_labels.parquet")
    ranker = reading.train(docs, labels.where("doc_id % 4 <> 0"), "doc_id")
    held = labels.where("doc_id % 4 = 0").groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    got = reading.levels(docs.join(held, "doc_id"), "doc_id", ranker).join(held, "doc_id").toPandas()
    whole = got[got["grade"] % 1 == 0]
    assert len(whole) > 100 and (whole["reading_level"] == whole["grade"]).mean() > 0.88


def test_reading_edge_cases(spark):
    docs = spark.createDataFrame([(1, "The cat sat. It was fat."), (2, None), (3, ""), (4, "   "), (5, "x" * 1_000_000), (6, "12 34 !!")], "doc_id long, text string")
    none = reading.train(docs, spark.createDataFrame([], "doc_id long, rater string, reading_level int"), "doc_id")
    got = {r.doc_id: r.reading_level for r in reading.levels(docs, "doc_id", none).collect()}
    assert got == {1: 2, 4: 2, 5: 2, 6: 2}
    one = reading.train(docs, spark.createDataFrame([(1, "r", 3), (1, "s", None), (2, "r", 1)], "doc_id long, rater string, reading_level int"), "doc_id")
    assert {r.reading_level for r in reading.levels(docs, "doc_id", one).collect()} == {3}


def test_isotonic_is_the_best_monotone_fit():
    x, y = np.arange(6.0), np.array([1.0, 3.0, 2.0, 2.0, 5.0, 4.0])
    knots, values = reading.isotonic(x, y, np.ones(6))
    assert list(np.interp(x, knots, values)) == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])
