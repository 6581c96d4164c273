import datetime as dt
from difflib import SequenceMatcher

from ledgerloom.plans import record_queries

D = dt.date(2024, 2, 3)
# id, source, transaction_date, its day (None: unusable), amount, merchant
ROWS = [
    ("r1", "receipt", "2024-02-03", D, 20.0, "acme"), ("r2", "receipt", "20240203", D, 30.0, "acme"), ("r3", "receipt", "2024-02-03T23:30:00-05:00", D, 40.0, "acme"), ("r4", "receipt", "03/02/2024", D, 50.0, "acme"),
    ("r5", "receipt", "3 Feb 2024", D, 60.0, "acme"), ("r6", "receipt", "soon", None, 20.0, "acme"), ("r7", "receipt", None, None, 20.0, "acme"), ("r8", "receipt", "1706918400", dt.date(2024, 2, 2), 70.0, "acme"), ("r9", "receipt", "2024-02-03 25:00", None, 20.0, "acme"),
    ("b1", "bank", "2024-02-05", dt.date(2024, 2, 5), 20.0, "acme"), ("b2", "bank", "02/03/2024", D, 20.0, "acme"), ("b3", "bank", "03.02.2024", D, 30.0, "acme tools"), ("b4", "bank", "2024/02/04", dt.date(2024, 2, 4), 40.0, "zzz"),
    ("b5", "bank", "2024-02-03", D, 50.0, "acme"), ("b6", "bank", "2024-02-06", dt.date(2024, 2, 6), 60.0, "acme"), ("b7", "bank", "2024-01-31", dt.date(2024, 1, 31), 70.0, "acme"), ("b8", "bank", None, None, 60.0, "acme"),
]


def store(spark, folder):
    rows = [(i, s, t, a, m, None) for i, s, t, _, a, m in ROWS]
    spark.createDataFrame(rows, "id string, source string, transaction_date string, amount double, merchant_raw string, merchant_norm string").write.parquet(f"{folder}/canonical_records.parquet")
    spark.createDataFrame([("receipt", "America/New_York", "dmy"), ("bank", "UTC", "mdy")], "source string, zone string, date_order string").write.parquet(f"{folder}/source_profiles.parquet")


def met():
    for r in (r for r in ROWS if r[1] == "receipt" and r[3]):
        for b in (b for b in ROWS if b[1] == "bank" and b[3]):
            days, cents = abs((r[3] - b[3]).days), abs(r[4] - b[4])
            if days < 3 and cents < 10:
                yield r, b, 1 - days / 3, 1 - cents / 10


def brute(similarity):
    best = {r[0]: (None, 0.0) for r in ROWS if r[1] == "receipt"}
    for r, b, date, amount in met():
        score = round(0.3 * date + 0.5 * amount + 0.2 * similarity(r[5], b[5]), 6)
        if score > best[r[0]][1]:
            best[r[0]] = (b[0] if score >= 0.75 else None, score)
    return best


def floored(a, b):
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= 0.7 else 0.0


def test_every_receipt_is_matched_whatever_the_writing_of_dates(spark, tmp_path):
    store(spark, tmp_path)
    got = lambda q: {r.left_id: (r.right_id, r.score) for r in q(spark, str(tmp_path)).collect()}
    assert got(record_queries.best_match_ratio) == brute(floored)
    assert got(record_queries.best_match_all) == brute(lambda a, b: float(a == b))
    assert brute(floored)["r1"] == ("b2", 1.0) and brute(floored)["r4"] == ("b5", 1.0) and brute(floored)["r8"][0] == "b7"
    wanted = {(r[0], b[0], round(0.5 * date + 0.5 * amount, 6)) for r, b, date, amount in met()}
    assert {(r.left_id, r.right_id, r.score) for r in record_queries.candidates_all(spark, str(tmp_path)).collect()} == wanted
