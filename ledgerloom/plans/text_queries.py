"""Text, receipt, number, date, JSON and key functions over whole tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import receipts, scalars, text
from ledgerloom.operators import rules
from ledgerloom.runtime import table

# Example tables of this repository's queries; users pass their own.
EXAMPLE_RULES = [
    ("PLUMB", "Repairs", 0.9), ("AUTO REPAIR", "Vehicle", 0.9), ("FUEL", "Vehicle", 0.85), ("PARKING", "Vehicle", 0.7), ("COFFEE", "Meals", 0.9),
    ("BAKERY", "Meals", 0.85), ("NOODLE", "Meals", 0.85), ("SEAFOOD", "Meals", 0.7), ("INSUR", "Insurance", 0.9), ("LEGAL", "Professional", 0.9),
    ("SOFTWARE", "Software", 0.9), ("OFFICE", "Supplies", 0.7), ("PRINT", "Supplies", 0.7), ("COLLEGE", "Education", 0.85), ("TRAINING", "Education", 0.7),
]
EXAMPLE_MAP = {"Food & Dining": "Meals", "Transportation": "Vehicle", "Shopping & Retail": "Supplies", "Utilities & Services": "Utilities", "Healthcare & Medical": "Health", "Income": "Income"}


def _names(spark: SparkSession, root: str):
    return table(spark, root, "canonical_records").select("id", "merchant_raw", "merchant_norm", "amount", "direction", "category_pred", "category_final", "raw_payload", "transaction_date", "source", "source_record_id")


def str_merchant(spark, root):
    """STR-01..05: clean, alias brand, root, normalised merchant."""
    c = text.clean_merchant(F.col("merchant_raw"))
    d = _names(spark, root).select("id", c.alias("clean"))
    return d.select("id", "clean", text.first_alias(F.col("clean")).alias("brand"), text.root_merchant(F.col("clean")).alias("root"), F.lower(F.coalesce(text.first_alias(F.col("clean")), F.col("clean"))).alias("norm"))


_JUNK = ", ".join(f"'{w}'" for w in text.JUNK_TOKENS)
_ALIAS_CASE = "case " + " ".join("when contains(clean, '{}') then '{}'".format(a, b.replace("'", "''")) for a, b in text.ALIASES.items()) + " end"
_STR_SQL = rf"""
    with a as (select id, regexp_replace(coalesce(merchant_raw, ''), '(?i)^\s*(SQ|TST|PAYPAL|PP|POS|SQUARE)\s*\*?\s+', '') t from canonical_records),
    b as (select id, upper(regexp_replace(t, '(?i)^\s*AMZN\s+(MKTP|MKTPLACE)\b', 'AMZN ')) t from a),
    c as (select id, regexp_replace(t, '\b(STORE|STR|LOCATION|LOC|TERMINAL|TERM|ID)\s*#?\s*\d+\b', ' ', 'g') t from b),
    d as (select id, regexp_replace(t, '\b\d{{2,4}}[-\s]\d{{2,4}}[-\s]\d{{2,4}}\b', ' ', 'g') t from c),
    e as (select id, regexp_replace(t, '\b#\d{{2,}}\b|\b\d{{4,}}[A-Z]?\b', ' ', 'g') t from d),
    f as (select id, trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) t from e),
    g as (select id, array_to_string(list_filter(string_split(t, ' '), lambda w: w not in ({_JUNK})), ' ') t from f),
    h as (select id, trim(regexp_replace(t, '(?:(?:^| )(?:CA|NY|TX|FL|IL|PA|OH|WA))+$', '')) as clean from g)
    select id, clean, {_ALIAS_CASE} as brand,
           case when clean = '' then 'UNKNOWN' else array_to_string(string_split(clean, ' ')[1:2], ' ') end as root,
           lower(coalesce({_ALIAS_CASE}, clean)) as norm from h"""


def str_normalised_text(spark, root):
    """STR-06..07: normalised and combined text."""
    t = table(spark, root, "staging_transactions")
    return t.select("rowid", text.normalised_text(F.col("description")).alias("description_norm"), text.combined(F.col("merchant_raw"), F.col("description"), F.col("mcc_description")).alias("combined"))


_CUR, _CTY = r"\b(?:usd|eur|gbp|cad|aud|inr|jpy)\b", r"\b(?:us|usa|uk|gb|in|india|ca|canada|au|australia|sg|singapore|ae|uae|de|germany|fr|france)\b"


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '{_CUR}', ' ', 'g'), '{_CTY}', ' ', 'g'), '\\s+', ' ', 'g'))"


def str_flags(spark, root):
    """STR-10..12: slug, blob, generic description test."""
    t = table(spark, root, "staging_transactions")
    return t.select("rowid", text.slug(F.col("category_external")).alias("slug"), F.upper(F.concat_ws(" ", "merchant_raw", "description", "mcc_description")).alias("blob"), text.mentions_any(F.col("description"), ["PURCHASE", "ORDER", "DEBIT", "SALE"]).cast("int").alias("generic_description"))


def ext_receipts(spark, root):
    """EXT-01..07 on the texts of source receipt_ocr."""
    r = table(spark, root, "documents").where("source = 'receipt_ocr' and text is not null")
    t = F.col("text")
    return r.select("doc_id", receipts.merchant_of(t).alias("merchant"), receipts.date_of(t).alias("receipt_date"), receipts.total_of(t).alias("total"), receipts.tax_of(t).alias("tax"), receipts.tip_of(t).alias("tip"))


def _amount_sql(words: str) -> str:
    money = r"(-?\$?\s*\d[\d,]*[.,]\d{2})(?:\D|$)"
    one = lambda x: f"list_last(regexp_extract_all({x}, '(?:^|\\D){money}', 1))"
    num = lambda x: f"try_cast(case when not regexp_matches(trim(regexp_replace({one(x)}, '[$,]', '', 'g')), '\\s') then trim(regexp_replace({one(x)}, '[$,]', '', 'g')) end as double)"
    return f"""abs(list_filter(list_transform(range(1, len(ls) + 1), lambda i: case when regexp_matches(upper(ls[i]), '\\b(?:{words})\\b') then coalesce({num('ls[i]')}, {num("coalesce(ls[i + 1], '')")}) end), lambda v: v is not null)[1])"""


def ext_last_number(spark, root):
    """EXT-08: last number of each ledger memo."""
    d = table(spark, root, "documents").where("source = 'ledger_memo'")
    return d.select("doc_id", receipts.last_number(F.col("text")).alias("last_number"))


def num_loaded_amounts(spark, root):
    """NUM-01, NUM-03: lenient number and direction of bank amounts as text."""
    n = scalars.number(F.col("Amount"))
    return table(spark, root, "bank_bofa").select("record_id", n.alias("amount"), F.abs(n).alias("magnitude"), scalars.signed_direction(n).alias("direction"))


def num_direction(spark, root):
    """NUM-04: direction stated, by sign or by category."""
    return table(spark, root, "gold_transactions").select("id", scalars.inferred_direction(F.col("direction"), F.col("amount"), F.col("category_final")).alias("direction"))


def num_bins(spark, root):
    """NUM-06: confidence bins counted per source."""
    c = table(spark, root, "canonical_records").select("source", scalars.confidence_bin(F.col("confidence")).alias("bin"))
    return c.groupBy("source", "bin").agg(F.count("*").alias("n"))


def dat_iso(spark, root):
    """DAT-01: ISO or US dates to ISO, others kept."""
    return table(spark, root, "quickbooks_sample").select("record_id", scalars.iso_date(F.col("Date")).alias("iso"))


def dat_months(spark, root):
    """DAT-05..06: next month clamped to its end, quarter and label."""
    g = table(spark, root, "gold_transactions").select("id", F.col("transaction_date").try_cast("date").alias("d"))
    return g.select("id", F.add_months("d", 1).cast("string").alias("next_month"), F.quarter("d").alias("quarter"), F.date_format("d", "MMM yyyy").alias("label"))


def jsn_payload(spark, root):
    """JSN-01..02: payload fields with fallbacks, invalid JSON gives null."""
    g = table(spark, root, "gold_transactions")
    p = F.col("raw_payload")
    return g.select("id", scalars.json_text(p, "mcc").alias("mcc"), F.coalesce(scalars.json_text(p, "description"), scalars.json_text(p, "mcc_description"), F.lit("")).alias("context"), F.coalesce(scalars.json_text(p, "label_source"), F.lit("unknown")).alias("label_source"))


def map_external(spark, root):
    """MAP-01..07: mapped external categories counted with status."""
    t = table(spark, root, "staging_transactions").select(F.trim("category_external").alias("external"))
    c = t.groupBy("external").agg(F.count("*").alias("n"))
    m = rules.mapped(F.col("external"), EXAMPLE_MAP)
    return c.select("external", "n", m.alias("mapped"), F.when(m.isNull(), "unmapped").otherwise("mapped").alias("status"))


_MAP_CASE = "case trim(category_external) " + " ".join(f"when '{a}' then '{b}'" for a, b in EXAMPLE_MAP.items()) + " end"


def prj_stable_id(spark, root):
    """PRJ-08..10: deterministic key, stable id, fingerprint."""
    g = table(spark, root, "gold_transactions")
    money = scalars.money_key(F.col("amount"))
    stable = scalars.stable_id(F.col("source"), F.upper(F.trim(F.col("merchant_raw"))), F.col("transaction_date"), money, F.lower(F.trim(F.col("direction"))))
    key = F.coalesce(F.concat_ws(":", F.col("source"), text.blank_to_null(F.col("source_record_id"))), F.col("id"))
    return g.select("id", key.alias("record_key"), stable.alias("stable_id"), scalars.fingerprint(F.col("merchant_raw"), scalars.json_text(F.col("raw_payload"), "description"), money).alias("fingerprint"))


def rul_first_match(spark, root):
    """RUL-01..07 with an example table: ordered first match on the name, then on the description, then a mapping, then a fallback."""
    t = table(spark, root, "staging_transactions")
    ext = rules.mapped(F.col("category_external"), EXAMPLE_MAP)
    step = F.when(ext.isNotNull(), F.struct(F.lit("external").alias("token"), ext.alias("label"), F.lit(0.7).alias("confidence")))
    last = F.struct(F.lit("fallback").alias("token"), F.lit("Other").alias("label"), F.lit(0.3).alias("confidence"))
    hit = rules.cascade(rules.first_match(F.col("merchant_raw"), EXAMPLE_RULES), rules.first_match(F.col("description"), EXAMPLE_RULES), step, last)
    return t.select("rowid", hit.alias("h")).select("rowid", F.col("h.label").alias("label"), F.col("h.token").alias("reason"), F.col("h.confidence").alias("confidence"))


def _case(col: str, i: int) -> str:
    out = "case " + " ".join(f"when contains(upper(coalesce({col}, '')), '{r[0]}') then {repr(r[i])}" for r in EXAMPLE_RULES)
    return out + " end"


def prj_rule_hits(spark, root):
    """PRJ-05: all tokens contained, counted."""
    t = table(spark, root, "gold_transactions").select(F.explode(rules.all_matches(F.col("merchant_raw"), [r[0] for r in EXAMPLE_RULES])).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


QUERIES = {
    "str_01_merchant": str_merchant, "str_06_normalised_text": str_normalised_text, "str_10_flags": str_flags, "ext_01_receipts": ext_receipts, "ext_08_last_number": ext_last_number,
    "num_01_amounts": num_loaded_amounts, "num_04_direction": num_direction, "num_06_bins": num_bins, "dat_01_iso": dat_iso, "dat_05_months": dat_months, "jsn_02_payload": jsn_payload,
    "map_01_external": map_external, "prj_09_stable_id": prj_stable_id, "rul_01_first_match": rul_first_match, "prj_05_rule_hits": prj_rule_hits,
}
_NUMBER = """case when regexp_full_match(regexp_replace(trim("Amount"), '[$,]', '', 'g'), '[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?') then try_cast(regexp_replace(trim("Amount"), '[$,]', '', 'g') as double) end"""
_DESC = """nullif(trim(case when json_valid(raw_payload) then json_extract_string(raw_payload, '$.{}') end), '')"""
ORACLES = {
    "str_01_merchant": _STR_SQL,
    "str_06_normalised_text": f"select rowid, {_norm_sql('description')} as description_norm, concat_ws(' ', nullif({_norm_sql('merchant_raw')}, ''), nullif({_norm_sql('description')}, ''), nullif({_norm_sql('mcc_description')}, '')) as combined from staging_transactions",
    "str_10_flags": "select rowid, replace(lower(category_external), ' ', '_') as slug, upper(concat_ws(' ', merchant_raw, description, mcc_description)) as blob, cast(regexp_matches(upper(coalesce(description, '')), 'PURCHASE|ORDER|DEBIT|SALE') as int) as generic_description from staging_transactions",
    "ext_01_receipts": rf"""
        with r as (select doc_id, text, string_split_regex(text, '\r?\n') as ls from documents where source = 'receipt_ocr' and text is not null),
        k as (select *, list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> '') as ks from r)
        select doc_id, list_filter(ks[1:5], lambda x: length(x) > 3 and not regexp_full_match(x, '\d+'))[1] as merchant,
          coalesce(nullif(regexp_extract(text, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1), ''),
            case when regexp_matches(text, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{2,4}})\b') then
              (case when length(regexp_extract(text, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{2,4}})\b', 3)) = 2 then '20' else '' end) || regexp_extract(text, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{2,4}})\b', 3)
              || '-' || lpad(regexp_extract(text, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{2,4}})\b', 1), 2, '0') || '-' || lpad(regexp_extract(text, '\b(\d{{1,2}})[/-](\d{{1,2}})[/-](\d{{2,4}})\b', 2), 2, '0') end) as receipt_date,
          {_amount_sql('TOTAL|AMOUNT|BALANCE|GRAND TOTAL')} as total, {_amount_sql('TAX|GST|SALES TAX')} as tax, {_amount_sql('TIP|GRATUITY')} as tip from k""",
    "ext_08_last_number": r"select doc_id, try_cast(replace(list_last(regexp_extract_all(text, '[-+]?\d[\d,]*\.?\d*')), ',', '') as double) as last_number from documents where source = 'ledger_memo'",
    "num_01_amounts": f"select record_id, {_NUMBER} as amount, abs({_NUMBER}) as magnitude, case when {_NUMBER} < 0 then 'expense' else 'income' end as direction from bank_bofa",
    "num_04_direction": "select id, case when lower(trim(direction)) in ('expense', 'income') then lower(trim(direction)) when amount < 0 then 'expense' when lower(category_final) = 'income' then 'income' else 'expense' end as direction from gold_transactions",
    "num_06_bins": "select source, case when confidence is null then 'missing' when confidence < 0.5 then '<0.50' when confidence < 0.7 then '0.50-0.70' when confidence < 0.85 then '0.70-0.85' else '>=0.85' end as bin, count(*) as n from canonical_records group by 1, 2",
    "dat_01_iso": r"""select record_id, coalesce(cast(case when regexp_matches("Date", '^\d{4}-\d{2}-\d{2}') then try_cast(substr("Date", 1, 10) as date) when regexp_full_match("Date", '\d{1,2}/\d{1,2}/\d{4}') then cast(try_strptime("Date", '%m/%d/%Y') as date) end as varchar), "Date") as iso from quickbooks_sample""",
    "dat_05_months": "select id, cast(cast(try_cast(transaction_date as date) + interval 1 month as date) as varchar) as next_month, cast(quarter(try_cast(transaction_date as date)) as int) as quarter, strftime(try_cast(transaction_date as date), '%b %Y') as label from gold_transactions",
    "jsn_02_payload": f"select id, {_DESC.format('mcc')} as mcc, coalesce({_DESC.format('description')}, {_DESC.format('mcc_description')}, '') as context, coalesce({_DESC.format('label_source')}, 'unknown') as label_source from gold_transactions",
    "map_01_external": f"select trim(category_external) as external, count(*) as n, any_value({_MAP_CASE}) as mapped, case when any_value({_MAP_CASE}) is null then 'unmapped' else 'mapped' end as status from staging_transactions group by 1",
    "prj_09_stable_id": f"""
        with m as (select *, coalesce(cast(cast(abs(amount) as decimal(18,2)) as varchar), '') as money from gold_transactions)
        select id, case when nullif(trim(source_record_id, ' '), '') is null then source else source || ':' || trim(source_record_id, ' ') end as record_key,
          'hash_' || substr(sha1(concat_ws('|', coalesce(source, ''), coalesce(upper(trim(merchant_raw, ' ')), ''), coalesce(transaction_date, ''), money, coalesce(lower(trim(direction)), ''))), 1, 16) as stable_id,
          lower(concat_ws(chr(9), coalesce(merchant_raw, ''), coalesce({_DESC.format('description')}, ''), money)) as fingerprint from m""",
    "rul_01_first_match": f"""select rowid, coalesce({_case('merchant_raw', 1)}, {_case('description', 1)}, {_MAP_CASE}, 'Other') as label,
        coalesce({_case('merchant_raw', 0)}, {_case('description', 0)}, case when {_MAP_CASE} is not null then 'external' end, 'fallback') as reason,
        cast(coalesce({_case('merchant_raw', 2)}, {_case('description', 2)}, case when {_MAP_CASE} is not null then 0.7 end, 0.3) as double) as confidence from staging_transactions""",
    "prj_05_rule_hits": "select token, count(*) as n from (select unnest(list_filter([" + ", ".join(f"'{r[0]}'" for r in EXAMPLE_RULES) + "], lambda t: contains(upper(coalesce(merchant_raw, '')), t))) as token from gold_transactions) group by 1",
}
