"""Fields of receipt text: merchant, date, total, tax, tip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an amount with two decimals.
MONEY = r"(?<!\d)(-?\$?\s*\d[\d,]*[.,]\d{2})(?!\d)"


def date_of(text: Column) -> Column:
    """First yyyy-mm-dd that stands alone, else first m/d/y or m-d-y as yyyy-mm-dd.

    Years of two to four digits count, those of two as 20yy; validity isn't
    checked; none gives null.
    """
    iso = F.nullif(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))
    us = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b"
    m, d, y = (F.regexp_extract(text, us, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.coalesce(iso, F.when(m != "", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))


def money_in(line: Column) -> Column:
    """Last money token of a line as a double; commas and $ are taken out, and space between sign and digits makes it no number."""
    last = F.try_element_at(F.regexp_extract_all(line, F.lit(MONEY), F.lit(1)), F.lit(-1))
    return F.trim(F.regexp_replace(last, r"[$,]", "")).try_cast("double")


def keyed_amount(text: Column, words: str) -> Column:
    """Absolute amount on the first line that has one of the words and money on it, or on the next line."""
    lines = F.split(text, r"\r?\n")
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
    both = F.arrays_zip(lines.alias("line"), after.alias("next"))
    hit = lambda x: F.when(F.upper(x["line"]).rlike(rf"\b(?:{words})\b"), F.coalesce(money_in(x["line"]), money_in(x["next"])))
    return F.abs(F.get(F.array_compact(F.transform(both, hit)), F.lit(0)))


# The words that mark a line.
def total_of(text: Column) -> Column:
    return keyed_amount(text, "TOTAL|AMOUNT|BALANCE|GRAND TOTAL")


def tax_of(text: Column) -> Column:
    return keyed_amount(text, "TAX|GST|SALES TAX")


def tip_of(text: Column) -> Column:
    return keyed_amount(text, "TIP|GRATUITY")


def merchant_of(text: Column) -> Column:
    """Among the first five lines that aren't blank the first of more than three characters and not all digits."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(F.filter(F.slice(lines, 1, 5), lambda x: (F.length(x) > 3) & ~x.rlike(r"^\d+$")), F.lit(0))


def last_number(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([-+]?\d[\d,]*\.?\d*)"), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), ",", "").try_cast("double")
