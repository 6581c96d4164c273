from decimal import Decimal

from ledgerloom.operators import rows
from ledgerloom.plans.row_queries import FEEDS

BANK = FEEDS[0]
CASES = [
    ("d,x,-1.00,t,m", None, None), ('d,"x, y",1,t,"a\nb"', None, None), ('d,"say ""hi""",($1.5),t,', None, None), ('d,x,"1,234.50",t,m', None, None), ("d,x, +5 ,t,m", None, None),
    ("d,x,1.00,t", "column_count", "Memo"), ("d,x,1.00,t,m,n", "column_count", "+"), ("", "column_count", "Description"), (None, "column_count", None),
    ('d,x"y,1.00,t,m', "quoting", "Description"), ('d,"x"y,1.00,t,m', "quoting", "Description"), ('d,x,1.00,t,"m', "quoting", "Memo"), ('d, "x",1.00,t,m', "quoting", "Description"), ('d,x"y,1', "quoting", "Description"),
    ("d,x,1.234,t,m", "value", "Amount"), ('d,x,"1,06,5.00",t,m', "value", "Amount"), ("d,x,,t,m", "value", "Amount"), ("d,x,$,t,m", "value", "Amount"), ("d,x,(1.00,t,m", "value", "Amount"), ("d,x,-(1.00),t,m", "value", "Amount"),
    ("d,x,1e3,t,m", "value", "Amount"), ("d,x,NaN,t,m", "value", "Amount"), ("d,x,--1,t,m", "value", "Amount"), ("d,x,1.,t,m", "value", "Amount"), ("d,x,١٢,t,m", "value", "Amount"),
    ('d,"' + 'x""' * 200_000 + '",1,t,m', None, None), ('d,"' + "x" * 1_000_000 + ",1,t,m", "quoting", "Description"),
]


def test_reasons_and_broken_fields(spark):
    df = spark.createDataFrame([(i, "bank_bofa", t, "clash") for i, (t, _, _) in enumerate(CASES)] + [(99, "other", "a", "c"), (100, None, "a", "c")], "record_id long, feed string, raw_text string, reason string")
    got = {r.record_id: (r.reason, r.broken_field) for r in rows.classify(df, "raw_text", "feed", FEEDS).select("record_id", "reason", "broken_field").collect()}
    assert {i: got[i] for i in range(len(CASES)) if got[i] != CASES[i][1:]} == {}
    assert got[99] == got[100] == ("feed", None)


def test_load(spark):
    df = spark.createDataFrame([(1, "bank_bofa", 'd,"say ""hi"", you",($1.5),t,""'), (2, "bank_bofa", "d,x,bad,t,m"), (1, "bank_bofa", "d,x, -$2 ,t,m")], "record_id long, feed string, raw_text string")
    got = sorted(map(tuple, rows.load(df, "raw_text", "feed", BANK, ("record_id",)).collect()))
    assert got == [(1, "d", 'say "hi", you', Decimal("-1.50"), "t", ""), (1, "d", "x", Decimal("-2.00"), "t", "m")]


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, feed string, raw_text string")
    assert rows.rejected(df, "raw_text", "feed", FEEDS).count() == 0
    assert rows.load(df, "raw_text", "feed", BANK).count() == 0


def fields(text):
    """Brute force tokeniser, letter by letter."""
    out, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            j = i + 1
            while True:
                k = text.find('"', j)
                if k < 0:
                    return None
                if text[k + 1 : k + 2] != '"':
                    break
                j = k + 2
            out.append(text[i + 1 : k].replace('""', '"'))
            i = k + 1
        else:
            k = text.find(",", i)
            k = n if k < 0 else k
            if '"' in text[i:k]:
                return None
            out.append(text[i:k])
            i = k
        if i == n:
            return out
        if text[i] != ",":
            return None
        i += 1


def test_quoting_and_counts_against_brute_force(spark):
    raw = spark.read.parquet("/root/testdata/sf0.01/raw_records.parquet")
    sizes = {f.name: len(f.header) for f in FEEDS}
    got = {r.record_id: r.reason for r in rows.rejected(raw, "raw_text", "feed", FEEDS).collect()}
    for r in raw.collect():
        f = fields(r.raw_text)
        wanted = "quoting" if f is None else "column_count" if len(f) != sizes[r.feed] else None
        assert (wanted or "value") == got.get(r.record_id, "value"), r.raw_text
