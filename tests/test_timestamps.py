import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from ledgerloom.operators import timestamps

CASES = [
    # source, text, norm
    ("ny", "2024-01-03", "2024-01-03"), ("ny", " 2024/1/3 ", "2024-01-03"), ("ny", "2024-01-03T00:00:00Z", "2024-01-03T00:00:00Z"), ("ny", "2024-01-03t03:18:00z", "2024-01-03T03:18:00Z"),
    ("ny", "2024-01-03 19:55:08", "2024-01-04T00:55:08Z"), ("ny", "2024-01-03 19:55", "2024-01-04T00:55:00Z"), ("ny", "2024-01-03T19:55:08.999", "2024-01-04T00:55:08Z"),
    ("ny", "2024-01-03 19:55:08 Europe/Berlin", "2024-01-03T18:55:08Z"), ("ny", "2024-01-03T19:55:08[Europe/Berlin]", "2024-01-03T18:55:08Z"), ("ny", "2024-01-03 19:55:08 America/New_York", "2024-01-04T00:55:08Z"),
    ("ny", "2024-01-04T01:27:10-03:30", "2024-01-04T04:57:10Z"), ("ny", "2024-01-04 01:27:10.123456+0530", "2024-01-03T19:57:10Z"), ("ny", "2024-01-04 01:27:10+02", "2024-01-03T23:27:10Z"),
    ("ny", "2024-07-01 12:00:00 EST", "2024-07-01T17:00:00Z"), ("ny", "2024-07-01 12:00:00 XYZ", "INVALID"), ("ny", "2024-07-01 12:00:00 Mars/Base", "INVALID"), ("ny", "2024-07-01T12:00:00+25:00", "INVALID"),
    ("ny", "01/02/2024", "2024-01-02"), ("uk", "01/02/2024", "2024-02-01"), ("ny", "13/02/2024", "2024-02-13"), ("uk", "02/13/2024", "2024-02-13"), ("ny", "1/2/24 04:05:06", "2024-01-02T09:05:06Z"),
    ("ny", "01.02.2024", "2024-02-01"), ("uk", "01.02.24 10:00", "2024-02-01T10:00:00Z"), ("ny", "31/04/2024 10:05", "INVALID"), ("ny", "02/30/2024", "INVALID"),
    ("ny", "3 Jan 2024", "2024-01-03"), ("ny", "03-JAN-24", "2024-01-03"), ("ny", "Jan 3, 2024", "2024-01-03"), ("ny", "Jan 3, 2024 12:25:58 am", "2024-01-03T05:25:58Z"), ("ny", "Jan 3, 2024 12:25:58 pm", "2024-01-03T17:25:58Z"),
    ("ny", "Wed, 03 Jan 2024 21:25:52 +0530", "2024-01-03T15:55:52Z"), ("ny", "01/03/2024 5:14 PM", "2024-01-03T22:14:00Z"), ("ny", "01/03/2024 13:14 PM", "INVALID"),
    ("ny", "20240103", "2024-01-03"), ("ny", "20240103190000", "2024-01-04T00:00:00Z"), ("ny", "20240104T170101Z", "2024-01-04T17:01:01Z"), ("ny", "1704240000", "2024-01-03T00:00:00Z"), ("ny", "1704240000180", "2024-01-03T00:00:00Z"),
    ("ny", "99999999", "INVALID"), ("ny", "0000-00-00", "INVALID"), ("ny", "2024-01-03T25:10:00Z", "INVALID"), ("ny", "2024-13-01T08:15:00Z", "INVALID"), ("ny", "pending", "INVALID"), ("ny", "2024-01-", "INVALID"), ("ny", "??/01/2024", "INVALID"),
    ("ny", "2024-03-10 02:30:00", "INVALID"), ("ny", "2024-11-03 01:30:00", "AMBIGUOUS"), ("ny", "2024-11-03 01:30:00 EDT", "2024-11-03T05:30:00Z"), ("ny", "2024-11-03 00:59:59", "2024-11-03T04:59:59Z"), ("ny", "2024-11-03 02:00:00", "2024-11-03T07:00:00Z"),
    ("uk", "2024-10-27 01:30:00", "AMBIGUOUS"), ("uk", "2024-03-31 01:30:00", "INVALID"), ("none", "2024-01-03 10:00:00", "AMBIGUOUS"), ("none", "2024-01-03", "2024-01-03"), ("ny", "", "INVALID"), ("ny", "   ", "INVALID"), ("ny", None, "INVALID"),
    ("ny", "a|b|c|d|e|f|g|h|i", "INVALID"), ("ny", "9" * 5000, "INVALID"), ("ny", "x" * 100_000, "INVALID"), (None, "2024-01-03 10:00:00", "AMBIGUOUS"),
]


def profiles(spark):
    return spark.createDataFrame([("ny", "America/New_York", "mdy"), ("uk", "Europe/London", "dmy"), (None, "Asia/Tokyo", "dmy")], "source string, zone string, date_order string")


def test_writings(spark):
    rows = [(i, s, t, n, "kept") for i, (s, t, n) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "seq long, source string, text string, wanted string, ts_date string").drop("ts_date").withColumn("zone", F.lit("clash")).withColumn("date_order", F.lit("clash"))
    got = timestamps.normalise(df, "text", "source", "seq", profiles(spark)).collect()
    assert len(got) == len(CASES)
    assert [(r.source, (r.text or "")[:50], r.norm) for r in got if r.norm != r.wanted] == []
    assert all(r.zone == "clash" for r in got)


def test_session_zone_has_no_influence(spark):
    df = spark.createDataFrame([(1, "ny", "2024-01-03 19:55:08")], "seq long, source string, text string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert timestamps.normalise(df, "text", "source", "seq", profiles(spark)).first().norm == "2024-01-04T00:55:08Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_empty_table(spark):
    df = spark.createDataFrame([], "seq long, source string, text string")
    assert timestamps.normalise(df, "text", "source", "seq", profiles(spark)).count() == 0


def test_undeclared_zone_is_estimated_from_the_order_of_arrival(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = []
    for i in range(4000):
        at = start + dt.timedelta(hours=2 * i) + dt.timedelta(minutes=7)
        rows.append((3 * i, "known", at.strftime("%Y-%m-%dT%H:%M:%SZ")))
        local = (at + dt.timedelta(minutes=3)).astimezone(ZoneInfo("Europe/Berlin"))
        rows.append((3 * i + 1, "new", local.strftime("%Y-%m-%d %H:%M:%S")))
        rows.append((3 * i + 2, "known", (at + dt.timedelta(minutes=6)).strftime("%Y-%m-%dT%H:%M:%SZ")))
    df = spark.createDataFrame(rows, "seq long, source string, text string")
    zones = ["America/New_York", "Europe/London", "Europe/Berlin", "Africa/Lagos", "UTC"]
    parsed = timestamps.parse(df, "text", None)
    found = timestamps.estimate_zones(parsed, "source", "seq", zones).collect()
    assert [(r.source, r.zone) for r in found] == [("new", "Europe/Berlin")]
    assert found[0].violations <= 24 and found[0].votes >= 3990  # violated on days of a change only, no vote where a run ends
    known = spark.createDataFrame([("known", "UTC", "mdy")], "source string, zone string, date_order string")
    norm = timestamps.normalise(df, "text", "source", "seq", known, candidates=zones)
    summer = norm.where("source = 'new' and text like '2024-07-01%'").first()
    local = dt.datetime.strptime(summer.text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo("Europe/Berlin"))
    assert summer.norm == local.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def naive_form(text, zone):
    """Brute force for year-first local times: tries both folds with the standard library."""
    m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d)", text)
    try:
        local = dt.datetime(*map(int, m.groups()))
    except ValueError:
        return "INVALID"
    z = ZoneInfo(zone)
    instants = set()
    for fold in (0, 1):
        u = local.replace(tzinfo=z, fold=fold).astimezone(dt.UTC)
        if u.astimezone(z).replace(tzinfo=None) == local:
            instants.add(u)
    if not instants:
        return "INVALID"
    return "AMBIGUOUS" if len(instants) > 1 else instants.pop().strftime("%Y-%m-%dT%H:%M:%SZ")


def test_local_times_against_brute_force(spark):
    root = "/root/testdata/sf0.01"
    p = spark.read.parquet(f"{root}/source_profiles.parquet")
    t = spark.read.parquet(f"{root}/staging_transactions.parquet").where(r"txn_ts rlike '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$'")
    zones = {r.source: r.zone for r in p.collect()}
    got = timestamps.normalise(t, "txn_ts", "source", "rowid", p).select("txn_ts", "source", "norm").collect()
    assert len(got) > 1000
    assert [r for r in got if r.norm != naive_form(r.txn_ts, zones[r.source])] == []
