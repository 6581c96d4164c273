"""Text and merchant functions, Column to Column; everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that the normalised merchant must not contain.
JUNK_TOKENS = "SQ POS SQUARE PAYPAL STRIPE HELP SUPPORT TST CA NY TX FL COM ORG NET INFO PHONE BILLING".split()
STATE_TAIL = "CA|NY|TX|FL|IL|PA|OH|WA"
INTERMEDIARY = r"(?i)^\s*(SQ|TST|PAYPAL|PP|POS|SQUARE)\s*\*?\s+"
MARKETPLACE = r"(?i)^\s*AMZN\s+(MKTP|MKTPLACE)\b"
STORE_LABEL = r"\b(STORE|STR|LOCATION|LOC|TERMINAL|TERM|ID)\s*#?\s*\d+\b"
THREE_NUMBERS = r"\b\d{2,4}[-\s]\d{2,4}[-\s]\d{2,4}\b"
STORE_ID = r"\b#\d{2,}\b|\b\d{4,}[A-Z]?\b"
CURRENCY_WORDS = r"(?i)\b(?:usd|eur|gbp|cad|aud|inr|jpy)\b"
COUNTRY_WORDS = r"(?i)\b(?:us|usa|uk|gb|in|india|ca|canada|au|australia|sg|singapore|ae|uae|de|germany|fr|france)\b"
# Alias and brand, longest alias first, equal lengths in this order.
ALIASES = {
    "HOTEL MARRIOTT": "Marriott", "OFFICE DEPOT": "Office Depot", "WHOLE FOODS": "Whole Foods", "TRADER JOES": "Trader Joe's",
    "TRADER JOS": "Trader Joe's", "HOME DEPOT": "Home Depot", "STARBUCKS": "Starbucks", "AMZN MKTP": "Amazon",
    "UBER EATS": "Uber Eats", "MICROSOFT": "Microsoft", "WHOLEFDS": "Whole Foods", "MARRIOTT": "Marriott", "BEST BUY": "Best Buy",
    "CHEVRON": "Chevron", "SPOTIFY": "Spotify", "NETFLIX": "Netflix", "STAPLES": "Staples", "AMAZON": "Amazon", "COSTCO": "Costco",
    "HILTON": "Hilton", "AIRBNB": "Airbnb", "GOOGLE": "Google", "SHELL": "Shell", "EXXON": "Exxon", "HYATT": "Hyatt", "APPLE": "Apple",
    "ADOBE": "Adobe", "LOWES": "Lowes", "SBUX": "Starbucks", "AMZN": "Amazon", "UBER": "Uber", "LYFT": "Lyft",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_merchant(c: Column) -> Column:
    """Merchant text without intermediary, store, terminal and number noise, in capitals (null gives '')."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), INTERMEDIARY, "")
    t = F.upper(F.regexp_replace(t, MARKETPLACE, "AMZN "))
    for noise in (STORE_LABEL, THREE_NUMBERS, STORE_ID):
        t = F.regexp_replace(t, noise, " ")
    t = squeezed(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " "))
    kept = F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin(JUNK_TOKENS)), " ")
    return F.trim(F.regexp_replace(kept, rf"(?:(?:^| )(?:{STATE_TAIL}))+$", ""))


def first_alias(clean: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Brand of the first alias that the text contains, else null."""
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(b).alias("brand")) for a, b in aliases.items()])
    return F.get(F.filter(table, lambda x: F.contains(clean, x["alias"])), F.lit(0))["brand"]


def root_merchant(clean: Column, words: int = 2) -> Column:
    return F.when(clean == "", "UNKNOWN").otherwise(F.array_join(F.slice(F.split(clean, " "), 1, words), " "))


def normalised_merchant(c: Column, case: str = "lower") -> Column:
    clean = clean_merchant(c)
    out = F.coalesce(first_alias(clean), clean)
    return {"lower": F.lower, "upper": F.upper}.get(case, lambda x: x)(out)


def normalised_text(c: Column, currencies: bool = True, countries: bool = True) -> Column:
    """Lower case, currency and country words taken out, blanks squeezed; null gives ''."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    if currencies:
        t = F.regexp_replace(t, CURRENCY_WORDS, " ")
    if countries:
        t = F.regexp_replace(t, COUNTRY_WORDS, " ")
    return squeezed(t)


def combined(*cs: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(normalised_text(c), F.lit("")) for c in cs])


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def mentions_any(c: Column, words: list[str]) -> Column:
    upper = F.upper(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(upper, w))
