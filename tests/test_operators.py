import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import receipts, scalars, text
from ledgerloom.operators import evaluate, generate, joins, learning, ledger, rules, sampling
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import landing


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "norm"), [
    ("SQ *STARBUCKS COFFEE 1234 SF CA", "starbucks"), ("PAYPAL *SPOTIFY PREMIUM 998877", "spotify"), ("AMZN MKTP US*2L3AB STORE 1234 WA", "amazon"), ("TST*JOES PIZZA TERMINAL 4455 NY NY", "joes pizza"),
    ("AMZN MKTP MERCHANT LLC", "amazon"), ("UBER TRIP SAN FRANCISCO", "uber"), ("WHOLE FOODS MKT", "whole foods"), (None, ""), ("CAFÉ-X", "café x"), ("CA NY", ""),
])
def test_merchants(spark, raw, norm):
    assert one(spark, text.normalised_merchant(F.col("a")), a=raw) == norm


def test_receipt(spark):
    t = "COFFEE SHOP\nDate: 02/21/2026\nSubtotal 3.10\nTax 0.40\nTip\n1.00\nTOTAL $4.50"
    c = F.col("a")
    assert one(spark, receipts.merchant_of(c), a=t) == "COFFEE SHOP"
    assert one(spark, receipts.date_of(c), a=t) == "2026-02-21"
    assert (one(spark, receipts.total_of(c), a=t), one(spark, receipts.tax_of(c), a=t), one(spark, receipts.tip_of(c), a=t)) == (4.5, 0.4, 1.0)
    assert one(spark, receipts.total_of(c), a="TOTAL 12,50") == 1250.0
    assert one(spark, receipts.total_of(c), a=None) is None


def test_numbers(spark):
    c = F.col("a")
    got = {a: one(spark, scalars.number(c), a=a) for a in ("$1,004.86", " 4.50 ", "4d", "1_000", "", "-3", None)}
    assert got == {"$1,004.86": 1004.86, " 4.50 ": 4.5, "4d": None, "1_000": None, "": None, "-3": -3.0, None: None}
    assert one(spark, scalars.iso_date(c), a="2/1/2026") == "2026-02-01"
    assert one(spark, scalars.iso_date(c), a="soon") == "soon"


def test_rules_keep_their_order(spark):
    table = [("UBER", "Travel", 0.9), ("UBER EATS", "Meals", 0.9), ("TAX", "Taxes", 0.7)]
    assert one(spark, rules.first_match(F.col("a"), table), a="uber eats").label == "Travel"
    assert one(spark, rules.first_match(F.col("a"), table), a="taxi").label == "Taxes"
    assert one(spark, rules.first_match(F.col("a"), table), a=None) is None


def side(spark, rows):
    return spark.createDataFrame(rows, "id string, day date, amount double, name string, rank int")


def test_best_match(spark):
    day = dt.date(2024, 5, 10)
    left = side(spark, [("a", day, 100.0, "x", 1), ("b", day, 500.0, "x", 2), ("c", None, 5.0, "x", 3), ("d", day, 50.0, "z", 4)])
    right = side(spark, [("r1", day, 100.0, "y", 1), ("r2", day, 100.0, "x", 2), ("r3", day + dt.timedelta(3), 500.0, "x", 3), ("r4", day, 510.0, "x", 4), (None, day, 50.0, "z", 5), ("r5", day, 50.0, "z", 6)])
    same = lambda a, b: F.when(a == b, 1.0).otherwise(0.0)
    got = {r.left_id: (r.right_id, round(r.score, 4)) for r in joins.best_match(left, right, same).collect()}
    assert got == {"a": ("r2", 1.0), "b": (None, 0.0), "c": (None, 0.0), "d": (None, 1.0)}
    ratio = {r.left_id: r.right_id for r in joins.best_match(left, right, joins.floored_ratio).collect()}
    assert ratio["a"] == "r2"


def test_not_in_has_null_rules(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    none = spark.createDataFrame([], "k string")
    assert joins.not_in(left, "id", none, "k").count() == 3
    assert [r.id for r in joins.not_in(left, "id", spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
    assert joins.not_in(left, "id", spark.createDataFrame([("a",), (None,)], "k string"), "k").count() == 0


def test_double_entry_balances(spark):
    df = spark.createDataFrame([("1", 5.0, "income"), ("2", 3.0, None), ("3", 0.0, "expense"), ("4", None, "expense"), ("5", float("nan"), "expense")], "id string, amount double, direction string")
    got = ledger.double_entry(df, "amount", "direction", F.lit("Travel"), "Clearing", "Income", ["id"])
    assert sorted((r.id, r.line, r.account, r.debit, r.credit) for r in got.collect()) == [("1", 1, "Clearing", 5.0, None), ("1", 2, "Income", None, 5.0), ("2", 1, "Travel", 3.0, None), ("2", 2, "Clearing", None, 3.0)]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "t string, p string")
    s = evaluate.summary(df, "t", "p").first()
    assert (s.accuracy, s.n) == (0.5, 4)
    assert evaluate.per_class(df, "t", "p").count() == 4


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"))
    sizes = {r["split"]: r["count"] for r in sampling.stratified_split(df, "id", "label", {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("split").count().collect()}
    assert abs(sizes["train"] - 700) <= 3 and sum(sizes.values()) == 1000
    assert sampling.sample(df, "id", 10).collect() == sampling.sample(df.repartition(7), "id", 10).collect()
    turns = sampling.round_robin(df, "label", "id", 6).groupBy("label").count().collect()
    assert {r["count"] for r in turns} == {2}


def test_learning(spark):
    df = spark.createDataFrame([("coffee shop latte", "meals"), ("coffee bar latte", "meals"), ("fuel station pump", "car"), ("fuel depot pump", "car"), (None, "car"), ("x", None)], "text string, label string")
    model = learning.text_classifier(df, "text", "label")
    got = learning.predictions(model, df.where("text is not null and label is not null"), ["label"]).collect()
    assert all(r.label == r.predicted_label and 0 < r.confidence <= 1 for r in got)
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(learning.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in v] == [0.0, None]


def test_generators(spark):
    df = spark.createDataFrame([("k1", "Acme Tools", dt.date(2024, 1, 1), 10.0)], "key string, name string, day date, amount double")
    p = generate.linked_pairs(df, "key", "day", "amount", "name").first()
    assert p.bank_amount <= -10.0 and 0 <= (p.bank_day - dt.date(2024, 1, 1)).days <= 2
    v = [r.variant for r in generate.variants(df, "name", 4).collect()]
    assert 1 <= len(v) <= 4 and len(set(v)) == len(v)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "bank.csv").write_text('Posting Date,Description,Amount,Type,Memo\n02/21/2026,"SHOP, ONE",-4.50,card,x\n02/22/2026,B,0,card,\n')
    df = readers.csv_rows(spark, str(tmp_path / "bank.csv"), ["Posting Date", "Description", "Amount", "Type", "Memo"])
    c = readers.canonical(df, "bank", "Posting Date", "Description", "Amount", 0.95, "bank_memo").orderBy("transaction_date").collect()
    assert (c[0].transaction_date, c[0].amount, c[0].direction, c[0].merchant_raw) == ("2026-02-21", 4.5, "expense", "SHOP, ONE") and c[1].amount is None
    assert set(readers.CANONICAL.fieldNames()) == set(c[0].asDict())
    writers.to_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    writers.append_new(spark, rows, str(tmp_path / "gold"), "id")
    writers.append_new(spark, spark.createDataFrame([("2", "b"), ("3", "c")], "id string, v string"), str(tmp_path / "gold"), "id")
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "gold")).collect()) == ["1", "2", "3"]
    assert {r.bytes for r in writers.manifest(spark, str(tmp_path / "gold")).where("path like '%.json'").collect()} != set()
    with pytest.raises(ValueError):
        writers.corpus(spark.createDataFrame([("x", "l")], "text string, label string"), str(tmp_path / "corpus"), "label", 2, 1)
    m = spark.createDataFrame([("Vendor: A; amount: $3: x; vendor: B",)], "t string").select(readers.key_values(F.col("t")).alias("m")).first().m
    assert m == {"vendor": "B", "amount": "$3: x"}
    api = readers.api_staging(spark.createDataFrame([("42", "ACME SUPPLY", "123.45", "1709251200000", "STATIONERY STORES")], "OBJECTID string, VENDOR_NAME string, TRANSACTION_AMOUNT string, TRANSACTION_DATE string, MCC_DESCRIPTION string")).first()
    assert (api.source_record_id, api.amount, api.txn_ts) == ("42", -123.45, "2024-03-01")
    (tmp_path / "r.txt").write_text("COFFEE SHOP\nTOTAL 4.50")
    assert readers.receipt_texts(spark, str(tmp_path / "r.txt")).first().total == 4.5


def test_streams(spark, tmp_path):
    from ledgerloom.plans.row_queries import FEEDS

    spark.createDataFrame([(1, "bank_bofa", "d,x,1,t,m"), (2, "bank_bofa", "d,x,bad,t,m")], "record_id bigint, feed string, raw_text string").write.parquet(str(tmp_path / "in"))
    q = landing.judged(landing.raw_stream(spark, str(tmp_path / "in")), FEEDS).writeStream.format("memory").queryName("judged").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.record_id, r.reason) for r in spark.table("judged").collect()} == {(1, None), (2, "value")}
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 5), "a") for h in (1, 1, 2, 9)], "ts timestamp, k string")
    ev.write.parquet(str(tmp_path / "ev"))
    s = landing.windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "ts", "k")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 1, 2]
