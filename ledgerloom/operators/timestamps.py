"""Timestamps in mixed writings, precisions and zones, brought to one form.

Everything is a Column expression: each writing has one anchored pattern that
rewrites the text into nine bar-separated fields, the fields become integers,
and the instant is integer arithmetic plus Spark's own zone rules. No Python
runs per row, and the session's time zone has no influence.

Zones: a zone or offset inside the text counts first, then the zone declared
for the source. For sources without a declared zone ``estimate_zones`` aligns
the naive local times with the instants of their neighbours in arrival order
and takes the zone whose history of offsets is violated least.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVALID = "INVALID"
AMBIGUOUS = "AMBIGUOUS"

# Months, zone abbreviations with their offsets in seconds, first
# and last second of the years in which values of digits only have to lie.
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 3600, "BST": 3600, "CET": 3600, "CEST": 7200,
    "EET": 7200, "EEST": 10800, "MSK": 10800, "IST": 19800, "JST": 32400, "KST": 32400,
    "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600,
    "PST": -28800, "PDT": -25200, "AKST": -32400, "AKDT": -28800, "HST": -36000,
}
DIGITS_FROM, DIGITS_UNTIL = 1672531200, 1798761599
MAX_OFFSET = 14 * 3600

_MONTH = rf"({MONTHS})(?:UARY|RUARY|CH|IL|E|Y|UST|T|TEMBER|OBER|EMBER)?\.?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}|\[[A-Z]{2,5}\]|\[?[A-Z][A-Z0-9_+-]*(?:/[A-Z0-9_+-]+)+\]?)"
_TIME = rf"(?:(?:T|, ?| AT | )(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d{{1,9}})?)?(?: ?([AP])\.?M\b\.?)?(?: ?{_ZONE})?)?"
_DAY = r"(?:[A-Z]{3,9},? )?"
# Each writing: its pattern, and which groups are year, month, day; the five groups after them are the time's.
_WRITINGS = (
    ("Y", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$", "$1|$3|$4", 5),
    ("Y", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d{{1,9}})?()(?: ?{_ZONE})?$", "$1|$2|$3", 4),
    ("D", r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})\d{0,3})?)?)?()()$", "$1|$2|$3", 4),
    ("S", rf"^(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}$", "$4|$1|$3", 5),
    ("Y", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_TIME}$", "$3|$2|$1", 4),
    ("Y", rf"^{_DAY}(\d{{1,2}})[ -]{_MONTH}[ ,-]{{1,2}}(\d{{4}}|\d{{2}}){_TIME}$", "$3|$2|$1", 4),
    ("Y", rf"^{_DAY}{_MONTH} (\d{{1,2}}),? (\d{{4}}){_TIME}$", "$3|$1|$2", 4),
    ("Y", rf"^(\d{{4}})[ -]{_MONTH}[ -](\d{{1,2}}){_TIME}$", "$1|$2|$3", 4),
)


def known_zones() -> dict[str, str]:
    """Upper-case spelling to name of every region zone of the tz database."""
    return {z.upper(): z for z in sorted(available_timezones()) if "/" in z and not z.startswith(("posix/", "right/", "SystemV/"))}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _pinned(c: Column) -> Column:
    """The same values, but filters on them stay above: pushed through the stages
    below they would copy each stage's expressions into the next, many times over."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _local_of(seconds: Column, zone: Column) -> Column:
    """Local wall time, as seconds, of an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone))


def _instant_of(local: Column, zone: Column) -> Column:
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def _text_of(instant: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of an instant in seconds, independent of the session's zone."""
    day = F.floor(instant / 86400).cast("int")
    rest = (instant - day.cast("long") * 86400).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"),
        two(F.floor((rest % 3600) / 60)), F.lit(":"), two(rest % 60), F.lit("Z"),
    )


def parse(df: DataFrame, text: str, date_order: str | Column | None, prefix: str = "ts_") -> DataFrame:
    """Add ``{prefix}kind, date, local, instant, zone`` for a text column.

    kind: ``date`` (no time), ``instant`` (Unix time or an offset in the text),
    ``zoned`` (a named zone in the text), ``local`` (no zone in the text) or
    ``invalid``. ``local`` is the wall time in seconds, ``instant`` the UTC
    seconds where known. ``date_order`` (``mdy`` or ``dmy``; null counts as
    ``mdy``) settles numeric dates when both orders are possible. Null, empty
    and blank texts are ``invalid``. Other columns stay as they are; columns
    that already have one of the new names are replaced.
    """
    p = prefix
    order = F.lit("mdy") if date_order is None else (F.col(date_order) if isinstance(date_order, str) else date_order)
    clean = F.btrim(F.col(text), F.lit(" \t\r\n\u00a0"))
    clean = F.translate(F.upper(F.regexp_replace(clean, r"\s+", " ")), "|", "!")
    fields = clean
    for tag, pattern, ymd, time in _WRITINGS:
        fields = F.regexp_replace(fields, pattern, f"{tag}|{ymd}|" + "|".join(f"${time + i}" for i in range(5)))
    df = df.withColumn(f"{p}text", clean).withColumn(f"{p}f", F.split(fields, r"\|", -1))

    f = lambda i: F.get(F.col(f"{p}f"), F.lit(i))
    known = F.size(f"{p}f") == 9
    year = F.when(F.length(f(1)) == 2, F.concat(F.lit("20"), f(1))).otherwise(f(1))
    named = F.instr(F.lit(MONTHS), f(2))
    month = F.when(f(2).rlike("^[A-Z]"), F.floor(named / 4 + 1).cast("string")).otherwise(f(2))
    made = lambda m, d: F.concat(year, F.lit("-"), m, F.lit("-"), d).try_cast("date")
    month_first, day_first = made(month, f(3)), made(f(3), month)
    date = F.when(~known, None).when(f(0) != "S", month_first)
    date = date.when(F.lower(order) == "dmy", F.coalesce(day_first, month_first)).otherwise(F.coalesce(month_first, day_first))
    digits = F.col(f"{p}text").rlike(r"^\d{9,19}$")
    number = F.col(f"{p}text").try_cast("decimal(20,0)")
    size = F.length(f"{p}text")
    unix = F.when(digits & (size <= 11), number).when(digits & (size <= 14), F.floor(number / 1000))
    unix = unix.when(digits & (size <= 17), F.floor(number / 1000000)).when(digits, F.floor(number / 1000000000)).cast("long")
    hour, half = _int(f(4)), f(7)
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    df = df.select(
        "*",
        date.alias(f"{p}date"),
        F.when(unix.between(DIGITS_FROM, DIGITS_UNTIL), unix).alias(f"{p}unix"),
        F.when(known & (f(4) != ""), F.when((hour <= 23) & (F.coalesce(_int(f(5)), F.lit(0)) <= 59) & (F.coalesce(_int(f(6)), F.lit(0)) <= 59), hour * 3600 + F.coalesce(_int(f(5)), F.lit(0)) * 60 + F.coalesce(_int(f(6)), F.lit(0))).otherwise(-1)).alias(f"{p}clock"),
        F.when(known, F.translate(f(8), "[]", "")).alias(f"{p}zonetext"),
        (known & (f(0) == "D")).alias(f"{p}digits"),
    )

    zone = F.col(f"{p}zonetext")
    hours, minutes = _int(F.substring(zone, 2, 2)), _int(F.substring(F.replace(zone, F.lit(":")), 4, 2))
    size_of = hours * 3600 + F.coalesce(minutes, F.lit(0)) * 60
    numeric = F.when((F.coalesce(minutes, F.lit(0)) < 60) & (size_of <= MAX_OFFSET), F.when(zone.startswith("-"), -size_of).otherwise(size_of))
    offset = F.when(zone.rlike(r"^[+-]"), numeric).when(~zone.contains("/"), _literal_map(ABBREVIATIONS)[zone])
    region = F.when(zone.contains("/"), _literal_map(known_zones())[zone])
    df = df.select(
        "*",
        F.when(zone != "", offset).alias(f"{p}offset"),
        F.when(zone != "", region).alias(f"{p}zone"),
        (F.datediff(F.col(f"{p}date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.coalesce(F.col(f"{p}clock"), F.lit(0))).alias(f"{p}local"),
    )
    in_years = F.year(f"{p}date").between(2023, 2026)
    bad_zone = (zone != "") & F.col(f"{p}offset").isNull() & F.col(f"{p}zone").isNull()
    kind = (
        F.when(F.col(f"{p}unix").isNotNull(), "instant")
        .when(F.col(f"{p}date").isNull() | (F.col(f"{p}clock") < 0) | F.coalesce(bad_zone, F.lit(False)) | (F.col(f"{p}digits") & ~in_years), "invalid")
        .when(F.col(f"{p}clock").isNull(), "date")
        .when(F.col(f"{p}offset").isNotNull(), "instant")
        .when(F.col(f"{p}zone").isNotNull(), "zoned")
        .otherwise("local")
    )
    instant = F.coalesce(F.col(f"{p}unix"), F.col(f"{p}local") - F.col(f"{p}offset"))
    return df.select("*", _pinned(kind).alias(f"{p}kind"), instant.alias(f"{p}instant")).drop(*[f"{p}{x}" for x in ("f", "unix", "clock", "zonetext", "digits", "offset", "text")])


def normal_form(df: DataFrame, home_zone: str, out: str = "norm", prefix: str = "ts_") -> DataFrame:
    """Add the one unambiguous form of a parsed timestamp as text column ``out``.

    Local times are read in the zone of the text, else in the zone in column
    ``home_zone``. A local time that occurred twice, or whose zone nobody
    knows, is ``AMBIGUOUS``; one that was skipped is ``INVALID``.
    """
    p = prefix
    zone = F.coalesce(F.col(f"{p}zone"), F.col(home_zone))
    wall = F.col(f"{p}kind").isin("local", "zoned")
    df = df.withColumn(f"{p}in", F.when(wall, zone)).withColumn(f"{p}utc", F.when(wall, _instant_of(F.col(f"{p}local"), F.col(f"{p}in"))))
    back = lambda shift: _local_of(F.col(f"{p}utc") + shift, F.col(f"{p}in")) == F.col(f"{p}local")
    twice = back(3600) | back(-3600) | back(1800) | back(-1800) | back(7200) | back(-7200)
    norm = (
        F.when(F.col(f"{p}kind") == "invalid", INVALID)
        .when(F.col(f"{p}kind") == "date", F.col(f"{p}date").cast("string"))
        .when(F.col(f"{p}kind") == "instant", _text_of(F.col(f"{p}instant")))
        .when(F.col(f"{p}in").isNull(), AMBIGUOUS)
        .when(~back(0), INVALID)
        .when(twice, AMBIGUOUS)
        .otherwise(_text_of(F.col(f"{p}utc")))
    )
    return df.withColumn(out, _pinned(norm)).drop(f"{p}in", f"{p}utc")


def local_day(df: DataFrame, text: str, home_zone: str, date_order: str, out: str = "day", prefix: str = "ts_") -> DataFrame:
    """Add date column ``out``: the calendar day of a timestamp text, as written; null for texts that are no date or time.

    A day in the text counts as it stands, whatever zone the text names; Unix
    times are read in the zone in column ``home_zone`` (UTC where it is null).
    """
    p = prefix
    parsed = parse(df, text, date_order, p)
    unix = F.date_from_unix_date(F.floor(_local_of(F.col(f"{p}instant"), F.coalesce(home_zone, F.lit("UTC"))) / 86400).cast("int"))
    day = F.when(F.col(f"{p}kind") != "invalid", F.coalesce(f"{p}date", unix))
    return parsed.withColumn(out, day).drop(*[f"{p}{x}" for x in ("kind", "date", "local", "instant", "zone")])


def estimate_zones(df: DataFrame, source: str, sequence: str, zones: list[str], prefix: str = "ts_", run: int = 4096, gap: int = 86400) -> DataFrame:
    """Zone of each source by its offset history: (source, zone, votes, violations).

    ``sequence`` is a whole number that rises with arrival. Every naive local
    time has a known instant before and one after it in that order, looked for
    in its run of ``run`` numbers and the runs beside it. Read in the right zone
    it lies between the two; every candidate zone in which it doesn't is
    violated once (pairs out of order, or more than ``gap`` seconds apart, say
    nothing). The zone with the fewest violations wins, ties by name. Rows are
    shuffled by run once and summed per source in one column a zone. Sources
    without votes are absent from the result.
    """
    p = prefix
    base = df.select(
        F.col(source).alias("source"),
        F.col(sequence).cast("long").alias("seq"),
        F.when(F.col(f"{p}kind") == "local", F.col(f"{p}local")).alias("local"),
        F.when(F.col(f"{p}kind") == "instant", F.col(f"{p}instant")).alias("known"),
    ).where("seq is not null and (local is not null or known is not null)")
    base = base.withColumn("run", F.floor(F.col("seq") / run))
    edges = base.where("known is not null").groupBy("run").agg(F.min_by("known", "seq").alias("first"), F.max_by("known", "seq").alias("last"))
    left, right = edges.select((F.col("run") + 1).alias("run"), F.col("last").alias("left")), edges.select((F.col("run") - 1).alias("run"), F.col("first").alias("right"))
    base = base.join(left, "run", "left").join(right, "run", "left")
    w = Window.partitionBy("run").orderBy("seq")
    before = F.coalesce(F.last("known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "left")
    after = F.coalesce(F.first("known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), "right")
    votes = base.select("source", "local", before.alias("a"), after.alias("b")).where(F.col("local").isNotNull() & F.col("b").between(F.col("a"), F.col("a") + gap))
    outside = lambda z: F.count_if(~F.coalesce(_instant_of(F.col("local"), F.lit(z)).between(F.col("a"), F.col("b")), F.lit(False)))
    sums = votes.groupBy("source").agg(F.count("*").alias("votes"), *[outside(z).alias(f"v{i}") for i, z in enumerate(zones)])
    best = F.array_min(F.array(*[F.struct(F.col(f"v{i}").alias("violations"), F.lit(z).alias("zone")) for i, z in enumerate(zones)]))
    return sums.select("source", best.alias("best"), "votes").select("source", "best.zone", "votes", "best.violations")


def normalise(df: DataFrame, text: str, source: str, sequence: str, profiles: DataFrame, out: str = "norm", candidates: list[str] | None = None) -> DataFrame:
    """Normalise a text column of timestamps; profiles has (source, zone, date_order).

    Sources that ``profiles`` doesn't have, or has without a zone, get the
    estimated zone (``candidates``: zones to try, by default those of the
    profiles); whether there are any is asked of the two narrow columns first,
    so that the estimate costs nothing where every zone is declared. Rows with
    a null source never have a home zone. Profiles must be small (one row a
    source) with one row a source; with several, the first by zone counts.
    """
    home = profiles.groupBy(F.col("source").alias("ts_source")).agg(F.min_by("zone", "zone").alias("ts_home"), F.min_by("date_order", "zone").alias("ts_order"))
    joined = df.join(home, F.col(source) == F.col("ts_source"), "left").drop("ts_source")
    parsed = parse(joined, text, "ts_order")
    if not df.select(F.col(source).alias("ts_source")).where("ts_source is not null").distinct().join(home.where("ts_home is not null"), "ts_source", "left_anti").isEmpty():
        zones = candidates or sorted(r[0] for r in home.select("ts_home").where("ts_home is not null").distinct().collect()) or ["UTC"]
        found = estimate_zones(parsed, source, sequence, zones).select(F.col("source").alias("ts_source"), F.col("zone").alias("ts_found"))
        parsed = parsed.join(found, F.col(source) == F.col("ts_source"), "left").withColumn("ts_home", F.coalesce("ts_home", "ts_found")).drop("ts_source", "ts_found")
    return normal_form(parsed, "ts_home", out).drop("ts_home", "ts_order", "ts_date", "ts_local", "ts_zone", "ts_kind", "ts_instant")
