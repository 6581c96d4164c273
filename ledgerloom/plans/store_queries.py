"""Stores, exports, lookups, queues and label governance over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, lookup, rules, sampling
from ledgerloom.plans.record_queries import _EFFECTIVE, _IN, CATEGORIES, _effective
from ledgerloom.runtime import Scratch, table, written
from ledgerloom.sources import store, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RUN, VERSION = "run-1", "1.0"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def canonical(spark, root):
    return table(spark, root, "canonical_records")


def gold(spark, root):
    return table(spark, root, "gold_transactions")


def staging(spark, root):
    return table(spark, root, "staging_transactions")


def exported(df, through=store.through_csv):
    """What another tool reads from the export."""
    with Scratch(df.sparkSession, "export") as scratch:
        return written(through(df, f"{scratch.folder}/file"), "read-back")


def blank(c):
    return F.nullif(F.trim(c), F.lit(""))


def payload(field: str, column: str = "raw_payload"):
    return F.nullif(F.trim(F.get_json_object(column, f"$.{field}")), F.lit(""))


def _pay(field: str, column: str = "raw_payload") -> str:
    return f"nullif(trim(case when json_valid({column}) then json_extract_string({column}, '$.{field}') end, ' '), '')"


def money(c):
    return F.col(c).cast("decimal(18,2)").cast("string")


_MONEY = "cast(cast({} as decimal(18,2)) as varchar)"


# ---- stores and keyed updates -------------------------------------------------------------------------------------


@query("snk_01_store", "select id, source, amount from canonical_records")
def appended(spark, root):
    """SNK-01: a store made by two appends, read back."""
    c = canonical(spark, root).select("id", "source", "amount")
    with Scratch(spark, "store") as scratch:
        path = f"{scratch.folder}/canonical"
        for part in (F.col("source") == "bank", ~F.coalesce(F.col("source") == "bank", F.lit(False))):
            store.append(c.where(part), path)
        return written(store.read(spark, path, c.schema), "store-rows")


@query("snk_02_staging_counts", "select source, count(*) as n, count(distinct source_record_id) as n_ids from staging_transactions group by 1")
def staging_counts(spark, root):
    """SNK-02: staging rows appended and counted per source."""
    s = staging(spark, root).select("rowid", "source", "source_record_id")
    with Scratch(spark, "staging") as scratch:
        store.append(s, f"{scratch.folder}/staging")
        back = store.read(spark, f"{scratch.folder}/staging", s.schema)
        return written(back.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("source_record_id").alias("n_ids")), "counts")


_LINKS = """select r.id, min(b.id) as linked from canonical_records r join canonical_records b on r.source = 'receipt' and b.source = 'bank'
    and r.transaction_date = b.transaction_date and round(r.amount * 100) = round(b.amount * 100) where r.matched_transaction_id is null group by 1"""


def _links(spark, root):
    c = canonical(spark, root).select("id", "source", "transaction_date", F.round(F.col("amount") * 100).alias("cents"), "matched_transaction_id")
    r = c.where("source = 'receipt' and matched_transaction_id is null").select("id", "transaction_date", "cents")
    b = c.where("source = 'bank'").groupBy("transaction_date", "cents").agg(F.min("id").alias("matched_transaction_id"))
    return r.join(b, ["transaction_date", "cents"]).select("id", "matched_transaction_id", F.lit(1.0).alias("match_score"))


@query("jon_04_linked", f"select c.id, coalesce(l.linked, c.matched_transaction_id) as matched_transaction_id, case when l.linked is not null then 1.0 else c.match_score end as match_score from canonical_records c left join ({_LINKS}) l on c.id = l.id")
def linked(spark, root):
    """JON-02, JON-04: links found by day and cents written back to the store by key."""
    c = canonical(spark, root).select("id", "matched_transaction_id", "match_score")
    return store.updated(c, "id", _links(spark, root))


@query("jon_02_link_count", f"select count(*) as n_links, count(distinct linked) as n_transactions from ({_LINKS})")
def link_count(spark, root):
    """JON-02: how many links are written back."""
    return _links(spark, root).agg(F.count("*").alias("n_links"), F.count_distinct("matched_transaction_id").alias("n_transactions"))


@query("rul_17_override", f"""select id, case when confidence < 0.4 then 'Travel' else category_final end as category_final, case when confidence < 0.4 then 'human' else {_pay('label_source')} end as label_source,
    case when confidence < 0.4 then 'low' else {_pay('label_confidence')} end as label_confidence, {_pay('description')} as description from canonical_records""")
def override(spark, root):
    """RUL-17, JSN-04: decisions of a reviewer set the category and stamp the payload, which keeps its other keys."""
    c = canonical(spark, root).select("id", "category_final", "raw_payload")
    stamp = store.merged_payload(F.col("raw_payload"), {"label_source": F.lit("human"), "label_confidence": F.lit("low")})
    changes = canonical(spark, root).where("confidence < 0.4").select("id", F.lit("Travel").alias("category_final"), stamp.alias("raw_payload"))
    out = store.updated(c, "id", changes)
    return out.select("id", "category_final", payload("label_source").alias("label_source"), payload("label_confidence").alias("label_confidence"), payload("description").alias("description"))


@query("snk_01_upsert", "select id, amount, 'new' as state from gold_transactions where ingest_batch >= 10 union all select id, amount, 'old' from gold_transactions where ingest_batch < 10")
def upserted(spark, root):
    """Rows of later batches replace those of their key and are added otherwise."""
    g = gold(spark, root).select("id", "amount", "ingest_batch")
    old = g.where("ingest_batch <= 12").select("id", F.lit(-1.0).alias("amount"), F.lit("old").alias("state")).where("id is not null")
    first = g.where("ingest_batch < 10").select("id", "amount", F.lit("old").alias("state"))
    late = g.where("ingest_batch >= 10").select("id", "amount", F.lit("new").alias("state"))
    return store.upsert(store.upsert(old, "id", first), "id", late)


# ---- exports, each read back from its files ------------------------------------------------------------------------


def _label_source():
    return F.when(F.col("category_final").isNotNull(), "human").when(payload("label_source").isNotNull(), payload("label_source")).when(payload("ml_prediction").isNotNull(), "ml").when(F.array_contains("tags", "ensemble"), "ensemble").otherwise("rules")


_LABEL = f"case when category_final is not null then 'human' when {_pay('label_source')} is not null then {_pay('label_source')} when {_pay('ml_prediction')} is not null then 'ml' when list_contains(tags, 'ensemble') then 'ensemble' else 'rules' end"


@query("prj_04_label_source", f"select id, {_LABEL} as label_source from canonical_records")
def label_source(spark, root):
    """PRJ-04: where a label comes from: a person, the payload's hint, a model, an ensemble, or rules."""
    return canonical(spark, root).select("id", _label_source().alias("label_source"))


_REASON = """case when category_final is not null then 'user override' when category_pred is not null then 'rule prediction (' || case when confidence >= 0.85 then 'high' when confidence >= 0.6 then 'medium' else 'low' end || ')' else 'fallback' end"""


def _reason():
    level = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return F.when(F.col("category_final").isNotNull(), "user override").when(F.col("category_pred").isNotNull(), F.concat(F.lit("rule prediction ("), level, F.lit(")"))).otherwise("fallback")


@query("prj_06_reason", f"select id, {_REASON} as decision_reason from canonical_records")
def reason(spark, root):
    """PRJ-06: the decision in words."""
    return canonical(spark, root).select("id", _reason().alias("decision_reason"))


def _enriched(c):
    receipt = F.when(F.col("source") == "receipt", F.col("id")).otherwise(F.when(F.col("matched_transaction_id").isNotNull(), F.col("matched_transaction_id")))
    return c.select(
        F.col("id").alias("transaction_id"), F.col("transaction_date").alias("date"), F.col("transaction_date").alias("posting_date"), blank("merchant_raw").alias("merchant_raw"), blank("merchant_norm").alias("merchant_normalized"),
        money("amount").alias("amount"), F.coalesce("currency", F.lit("USD")).alias("currency"), "direction", F.col("category_pred").alias("predicted_category"), F.col("category_final").alias("final_category"),
        _effective().alias("effective_category"), F.round("confidence", 4).alias("confidence"), _label_source().alias("label_source"), receipt.alias("receipt_id"), "matched_transaction_id", F.round("match_score", 4).alias("match_score"),
        F.nullif(F.array_join("evidence_keys", "|"), F.lit("")).alias("evidence_pointers"), "source", "source_record_id", F.lit(VERSION).alias("pipeline_version"), F.lit(RUN).alias("run_id"),
    )


@query("snk_07_enriched", f"""select id as transaction_id, nullif(transaction_date, '') as date, nullif(transaction_date, '') as posting_date, nullif(trim(merchant_raw, ' '), '') as merchant_raw, nullif(trim(merchant_norm, ' '), '') as merchant_normalized,
    {_MONEY.format('amount')} as amount, coalesce(currency, 'USD') as currency, direction, category_pred as predicted_category, category_final as final_category, {_EFFECTIVE} as effective_category, round(confidence, 4) as confidence, {_LABEL} as label_source,
    case when source = 'receipt' then id else matched_transaction_id end as receipt_id, matched_transaction_id, round(match_score, 4) as match_score, nullif(array_to_string(evidence_keys, '|'), '') as evidence_pointers,
    source, source_record_id, '{VERSION}' as pipeline_version, '{RUN}' as run_id from canonical_records""")
def enriched(spark, root):
    """SNK-07: the enriched transactions in their 21 columns, read back from CSV."""
    out = exported(_enriched(canonical(spark, root)))
    return out.withColumns({c: F.col(c).cast("double") for c in ("confidence", "match_score")})


@query("snk_08_gl_export", f"""
    with c as (select *, coalesce(lower(trim(direction, ' ')) = 'income', false) as earned, {_EFFECTIVE} as account, {_LABEL} as ls from canonical_records where amount > 0),
    l as (select *, 1 as line from c union all select *, 2 from c)
    select id as transaction_id, nullif(transaction_date, '') as posting_date, case when line = 1 then case when earned then 'Bank Clearing' else account end else case when earned then 'Income' else 'Bank Clearing' end end as account,
      case when line = 1 then {_MONEY.format('amount')} end as debit, case when line = 2 then {_MONEY.format('amount')} end as credit, nullif(trim(merchant_raw, ' '), '') as memo, coalesce(nullif(trim(merchant_norm, ' '), ''), nullif(trim(merchant_raw, ' '), '')) as entity,
      source, nullif(array_to_string(evidence_keys, '|'), '') as evidence, ls as label_source, '{VERSION}' as pipeline_version, '{RUN}' as run_id from l""")
def gl_export(spark, root):
    """SNK-08: double-entry lines with the twelve columns of the export, read back from CSV."""
    c = canonical(spark, root).select(
        F.col("id").alias("transaction_id"), F.col("transaction_date").alias("posting_date"), "amount", "direction", _effective().alias("own"), blank("merchant_raw").alias("memo"), F.coalesce(blank("merchant_norm"), blank("merchant_raw")).alias("entity"),
        "source", F.nullif(F.array_join("evidence_keys", "|"), F.lit("")).alias("evidence"), _label_source().alias("label_source"), F.lit(VERSION).alias("pipeline_version"), F.lit(RUN).alias("run_id"),
    )
    keep = ["transaction_id", "posting_date", "memo", "entity", "source", "evidence", "label_source", "pipeline_version", "run_id"]
    lines = ledger.double_entry(c, "amount", "direction", F.col("own"), "Bank Clearing", "Income", keep)
    return exported(lines.withColumns({"debit": money("debit"), "credit": money("credit")}).drop("line"))


@query("snk_10_bundle", f"""select 'enriched' as export, count(*) as rows, '{RUN}' as run_id from canonical_records union all select 'gl_lines', 2 * count_if(amount > 0), '{RUN}' from canonical_records
    union all select 'audit', count(*), '{RUN}' from canonical_records""")
def bundle(spark, root):
    """SNK-10: three exports written under one run id, counted from what was written."""
    c = canonical(spark, root)
    keep = c.select("id", "amount", "direction", _effective().alias("own"))
    parts = {"enriched": _enriched(c).drop("run_id"), "gl_lines": ledger.double_entry(keep, "amount", "direction", F.col("own"), "Bank Clearing", "Income", ["id"]), "audit": writers.audit_lines(c, RUN)}
    with Scratch(spark, "bundle") as scratch:
        return written(store.bundle(parts, scratch.folder, RUN), "bundle")


@query("snk_11_simple_import", f"""select nullif(transaction_date, '') as "Date", nullif(trim(merchant_raw, ' '), '') as "Description", {_MONEY.format('amount')} as "Amount", coalesce(nullif(trim(merchant_norm, ' '), ''), nullif(trim(merchant_raw, ' '), '')) as "Payee", {_EFFECTIVE} as "Category" from canonical_records""")
def simple_import(spark, root):
    """SNK-11: the five columns of the simple import, read back from CSV."""
    payee = F.coalesce(blank("merchant_norm"), blank("merchant_raw"))
    return exported(canonical(spark, root).select(F.col("transaction_date").alias("Date"), blank("merchant_raw").alias("Description"), money("amount").alias("Amount"), payee.alias("Payee"), _effective().alias("Category")))


@query("snk_12_totals", f"""select {_EFFECTIVE} as "Category", cast(sum(cast(amount as decimal(18,2))) as varchar) as "Amount", cast(count(*) as varchar) as "Count" from canonical_records where direction = 'expense' and amount is not null group by 1""")
def totals(spark, root):
    """SNK-12: totals per category with two decimals, sorted by category, read back from CSV."""
    c = canonical(spark, root).where("direction = 'expense' and amount is not null").groupBy(_effective().alias("Category"))
    t = c.agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("string").alias("Amount"), F.count("*").cast("string").alias("Count"))
    return exported(t.orderBy("Category"))


@query("snk_13_audit_pack", f"""select nullif(transaction_date, '') as "Date", nullif(trim(merchant_raw, ' '), '') as "Merchant", {_MONEY.format('amount')} as "Amount", direction as "Direction", category_final as "Category (User)", category_pred as "Category (Predicted)",
    matched_transaction_id as "Matched Transaction ID", cast(cast(round(match_score * 100) as int) as varchar) || '%' as "Match Score", cast(cast(round(confidence * 100) as int) as varchar) || '%' as "Confidence", source as "Source" from canonical_records""")
def audit_pack(spark, root):
    """SNK-13: the audit pack, newest first, with percentages."""
    percent = lambda c: F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))
    c = canonical(spark, root).orderBy(F.desc_nulls_last("transaction_date"))
    return exported(c.select(
        F.col("transaction_date").alias("Date"), blank("merchant_raw").alias("Merchant"), money("amount").alias("Amount"), F.col("direction").alias("Direction"), F.col("category_final").alias("Category (User)"), F.col("category_pred").alias("Category (Predicted)"),
        F.col("matched_transaction_id").alias("Matched Transaction ID"), percent("match_score").alias("Match Score"), percent("confidence").alias("Confidence"), F.col("source").alias("Source"),
    ))


@query("snk_09_audit_full", f"""select id as transaction_id, '{RUN}' as run_id, source, direction, {_EFFECTIVE} as effective, {_LABEL} as label_source, {_REASON} as reason, matched_transaction_id as matched, round(match_score, 4) as score, nullif(trim(merchant_norm, ' '), '') as norm from canonical_records""")
def audit_full(spark, root):
    """SNK-09: the nested audit object of every row, written as JSON lines and read back."""
    c = canonical(spark, root)
    lines = c.select(F.to_json(F.struct(
        F.col("id").alias("transaction_id"), F.lit(RUN).alias("run_id"), F.lit(VERSION).alias("pipeline_version"), F.struct("source", "source_record_id", "transaction_date", "merchant_raw", "amount", "currency", "direction", "payment_method").alias("inputs"),
        F.struct(blank("merchant_norm").alias("merchant_norm"), "evidence_keys", "tags").alias("transformations"), F.struct("matched_transaction_id", F.round("match_score", 4).alias("match_score")).alias("match_scores"),
        F.struct("category_pred", "category_final", _effective().alias("effective_category"), "confidence", _label_source().alias("label_source"), _reason().alias("reason")).alias("final_decision"),
    )).alias("value"))

    def through(df, path):
        df.write.mode("overwrite").text(path)
        return df.sparkSession.read.text(path)

    get = lambda p: F.get_json_object("value", p)
    return exported(lines, through).select(
        get("$.transaction_id").alias("transaction_id"), get("$.run_id").alias("run_id"), get("$.inputs.source").alias("source"), get("$.inputs.direction").alias("direction"), get("$.final_decision.effective_category").alias("effective"), get("$.final_decision.label_source").alias("label_source"),
        get("$.final_decision.reason").alias("reason"), get("$.match_scores.matched_transaction_id").alias("matched"), get("$.match_scores.match_score").cast("double").alias("score"), get("$.transformations.merchant_norm").alias("norm"),
    )


@query("snk_06_payloads", """select 'upload-' || substr(md5(id), 1, 2) as batch_name, count(*) as count, count(*) as in_payload from canonical_records group by 1""")
def payloads(spark, root):
    """SNK-06: JSON documents of bounded size for an API, counted from their text."""
    p = store.payloads(canonical(spark, root), "upload", "id", ["id", "merchant_raw", "amount"])
    return p.select("batch_name", "count", F.json_array_length(F.get_json_object("payload", "$.transactions")).cast("long").alias("in_payload"))


@query("snk_20_split_files", "select s.split, count(*) as n, min(g.id) as first_id from gold_transactions g join gold_splits s using (id) group by 1")
def split_files(spark, root):
    """SNK-20: one folder of CSV per split, read back by partition discovery."""
    g = gold(spark, root).select("id", "merchant_raw").join(table(spark, root, "gold_splits"), "id")
    with Scratch(spark, "splits") as scratch:
        g.write.mode("overwrite").partitionBy("split").option("header", True).option("escape", '"').csv(f"{scratch.folder}/splits")
        back = spark.read.schema("id string, merchant_raw string, split string").option("header", True).option("escape", '"').option("multiLine", True).csv(f"{scratch.folder}/splits")
        return written(back.groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first_id")), "split-counts")


def _flags(s):
    m, d, c = blank("merchant_raw"), blank("description"), blank("mcc")
    generic = F.upper(F.coalesce("description", F.lit(""))).rlike("PURCHASE|ORDER|DEBIT|SALE")
    i = lambda x: x.cast("int")
    return s.withColumns({
        "missing_merchant": i(m.isNull()), "missing_description": i(d.isNull()), "missing_mcc": i(c.isNull()), "merchant_only": i(m.isNotNull() & d.isNull() & c.isNull()), "generic_description": i(generic),
    })


_FLAGS = """cast(nullif(trim(merchant_raw, ' '), '') is null as int) as missing_merchant, cast(nullif(trim(description, ' '), '') is null as int) as missing_description, cast(nullif(trim(mcc, ' '), '') is null as int) as missing_mcc,
    cast(nullif(trim(merchant_raw, ' '), '') is not null and nullif(trim(description, ' '), '') is null and nullif(trim(mcc, ' '), '') is null as int) as merchant_only, cast(regexp_matches(upper(coalesce(description, '')), 'PURCHASE|ORDER|DEBIT|SALE') as int) as generic_description"""


@query("snk_03_enriched_staging", f"select rowid, source, {_FLAGS} from staging_transactions")
def enriched_staging(spark, root):
    """SNK-03, PRJ-07: staging rows with their indicator flags; the derived table is replaced as a whole."""
    s = _flags(staging(spark, root)).select("rowid", "source", "missing_merchant", "missing_description", "missing_mcc", "merchant_only", "generic_description")
    with Scratch(spark, "enriched") as scratch:
        for part in (s.where("rowid < 0"), s):
            part.write.mode("overwrite").parquet(f"{scratch.folder}/enriched")
        return written(store.read(spark, f"{scratch.folder}/enriched", s.schema), "enriched")


@query("snk_16_training_rows", f"select rowid, merchant_raw, {_pay('feed', 'raw_payload_json')} as feed, case when mcc is not null then 'mcc:' || mcc else 'fallback' end as reason, 1 as n_reasons from staging_transactions where merchant_raw is not null")
def training_rows(spark, root):
    """SNK-16: training rows as JSON lines with a list of reasons, read back."""
    s = staging(spark, root).where("merchant_raw is not null")
    rows = s.select("rowid", "merchant_raw", payload("feed", "raw_payload_json").alias("feed"), F.array(F.coalesce(F.concat(F.lit("mcc:"), "mcc"), F.lit("fallback"))).alias("mapping_reason"))
    return exported(rows, store.through_json).select("rowid", "merchant_raw", "feed", F.col("mapping_reason")[0].alias("reason"), F.size("mapping_reason").alias("n_reasons"))


@query("src_13_scan", "select rowid, merchant_raw, amount from staging_transactions where amount > 100 and currency = 'USD' order by rowid limit 500")
def scan(spark, root):
    """SRC-13: a scan with a condition and a limit given as values, in the order of rowid (a bounded scan is the feature)."""
    condition, least, currency, n = "amount > {least} and currency = {currency}", 100, "USD", 500
    return spark.sql(f"select rowid, merchant_raw, amount from {{t}} where {condition} order by rowid limit {{n}}", t=staging(spark, root), least=least, currency=currency, n=n)


# ---- lookups ---------------------------------------------------------------------------------------------------------


def _map(spark, root):
    g = gold(spark, root).where("trim(merchant_norm) <> '' and category_final is not null")
    return g.groupBy(F.upper(F.trim("merchant_norm")).alias("merchant")).agg(F.min("category_final").alias("category"))


_MAPSQL = "select upper(trim(merchant_norm, ' ')) as merchant, min(category_final) as category from gold_transactions where trim(merchant_norm, ' ') <> '' and category_final is not null group by 1"


@query("rul_08_exact", f"select c.id, m.category, case when m.category is not null then 0.95 end as confidence from canonical_records c left join ({_MAPSQL}) m on upper(trim(c.merchant_raw, ' ')) = m.merchant")
def exact(spark, root):
    """RUL-08: category by the exact name in a merchant table."""
    c = lookup.exact(canonical(spark, root).select("id", "merchant_raw"), F.upper(F.trim("merchant_raw")), _map(spark, root), "merchant", "category", "category")
    return c.select("id", "category", F.when(F.col("category").isNotNull(), 0.95).alias("confidence"))


@query("rul_09_contained", f"""with m as ({_MAPSQL}), n as (select distinct upper(trim(merchant_raw, ' ')) as name from canonical_records where trim(merchant_raw, ' ') <> ''),
    f as (select name, arg_min(category, merchant) as category from n join m on contains(name, merchant) or contains(merchant, name) group by 1)
    select c.id, f.category from canonical_records c left join f on upper(trim(c.merchant_raw, ' ')) = f.name""")
def contained(spark, root):
    """RUL-09: category of the first name of a merchant table that contains a row's name or is contained in it."""
    c = canonical(spark, root).select("id", F.upper(F.trim("merchant_raw")).alias("name"))
    return lookup.contained(c, "name", _map(spark, root), "merchant", "category", "merchant", "category").select("id", "category")


_LEARNED = """with d as (select id, upper(trim(merchant_norm, ' ')) as norm, upper(trim(merchant_raw, ' ')) as raw, category_final as f from canonical_records where category_final is not null),
    a as (select norm, arg_min(f, id) as f from d where norm <> '' group by 1), b as (select raw, arg_min(f, id) as f from d where raw <> '' group by 1)"""


@query("rul_11_learned", f"{_LEARNED} select c.id, coalesce(a.f, b.f) as learned from canonical_records c left join a on upper(trim(c.merchant_norm, ' ')) = a.norm left join b on upper(trim(c.merchant_raw, ' ')) = b.raw")
def learned(spark, root):
    """RUL-11: the decision made earlier for the same normalised or raw name."""
    return _learned(spark, root).select("id", "learned")


def _learned(spark, root):
    c = canonical(spark, root).select("id", "merchant_norm", "merchant_raw", "category_final", "category_pred", "confidence", "source")
    up = lambda x: F.upper(F.trim(x))
    return lookup.learned(c, c, {"norm": (up("merchant_norm"), up("merchant_norm")), "raw": (up("merchant_raw"), up("merchant_raw"))}, "category_final", "id", "learned")


@query("rul_12_cascade", f"""{_LEARNED}, m as ({_MAPSQL}) select c.id, coalesce(a.f, b.f, m.category, 'Other Expense') as category,
    case when coalesce(a.f, b.f) is not null then 'override' when m.category is not null then 'exact' else 'fallback' end as step, case when coalesce(a.f, b.f) is not null then 0.99 when m.category is not null then 0.95 else 0.3 end as confidence
    from canonical_records c left join a on upper(trim(c.merchant_norm, ' ')) = a.norm left join b on upper(trim(c.merchant_raw, ' ')) = b.raw left join m on upper(trim(c.merchant_raw, ' ')) = m.merchant""")
def cascade(spark, root):
    """RUL-12..13: earlier decision, exact name, fallback: the first that applies, with its confidence."""
    c = lookup.exact(_learned(spark, root), F.upper(F.trim("merchant_raw")), _map(spark, root), "merchant", "category", "exact")
    step = lambda v, n, p: F.when(v.isNotNull(), F.struct(v.alias("category"), F.lit(n).alias("step"), F.lit(p).alias("confidence")))
    return c.select("id", rules.cascade(step(F.col("learned"), "override", 0.99), step(F.col("exact"), "exact", 0.95), step(F.lit("Other Expense"), "fallback", 0.3)).alias("r")).select("id", "r.*")


@query("map_04_category", f"select category_external as raw, count(*) as n, case when any_value(trim(category_external, ' ')) in {_IN} then any_value(trim(category_external, ' ')) end as category from staging_transactions group by 1")
def category(spark, root):
    """MAP-04: category names folded to the taxonomy, null for others."""
    fold = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.lower(), c)])
    counts = staging(spark, root).groupBy(F.col("category_external").alias("raw")).agg(F.count("*").alias("n"))
    return counts.withColumn("category", fold[F.lower(F.trim("raw"))])


@query("map_05_required", f"select id, category_final from canonical_records where category_final in {_IN}")
def required(spark, root):
    """MAP-05: rows whose category must be valid; any other would fail the query."""
    c = canonical(spark, root).where(F.col("category_final").isin(CATEGORIES)).select("id", "category_final")
    return store.assert_rows(c, ~F.col("category_final").isin(CATEGORIES), "not a category")


@query("map_06_source", "select coalesce(nullif(case lower(trim(source, ' ')) when 'toast' then 'pos' when 'qb' then 'quickbooks' else lower(trim(source, ' ')) end, ''), 'unknown') as source, count(*) as n from gold_transactions group by 1")
def source_alias(spark, root):
    """MAP-06: sources under one name each, blank ones as unknown."""
    s = F.lower(F.trim("source"))
    alias = F.coalesce(rules.mapped(s, {"toast": "pos", "qb": "quickbooks"}), F.nullif(s, F.lit("")), F.lit("unknown"))
    return gold(spark, root).groupBy(alias.alias("source")).agg(F.count("*").alias("n"))


@query("map_07_bucket", "select rowid, case when lower(source) like '%card%' then 'bank' when lower(source) like 'eu%' then 'toast' else 'other' end as bucket from staging_transactions")
def bucket(spark, root):
    """MAP-07: sources in buckets by part or beginning of their name."""
    s = F.lower("source")
    return staging(spark, root).select("rowid", F.when(F.contains(s, F.lit("card")), "bank").when(F.startswith(s, F.lit("eu")), "toast").otherwise("other").alias("bucket"))


# ---- queues and gates --------------------------------------------------------------------------------------------------


def _two_models(spark, root):
    """Gold rows with the learned category of their payee's other rows as rule and category_pred as model."""
    g = gold(spark, root).where("category_final is not null").withColumn("who", F.lower(F.trim("merchant_norm")))
    n = g.groupBy("who", "category_final").agg(F.count("*").alias("n"))
    most = n.groupBy("who").agg(F.min_by("category_final", F.struct(-F.col("n"), "category_final")).alias("rule"), (F.max("n") / F.sum("n")).alias("rule_conf"))
    j = g.join(most, g["who"].eqNullSafe(most["who"])).select("id", "source", "transaction_date", F.col("category_final").alias("truth"), F.col("category_pred").alias("model"), "rule", F.round("rule_conf", 6).alias("rule_conf"), F.round("match_score", 6).alias("model_conf"), "ingest_batch")
    return j


_TWO = """g as (select *, lower(trim(merchant_norm, ' ')) as who from gold_transactions where category_final is not null), n as (select who, category_final, count(*) as n from g group by 1, 2),
    r as (select who, arg_min(category_final, (-n, category_final)) as rule, round(max(n) / sum(n), 6) as rule_conf from n group by 1),
    t as (select g.id, g.source, transaction_date, category_final as truth, category_pred as model, rule, rule_conf, round(match_score, 6) as model_conf, ingest_batch from g join r on g.who is not distinct from r.who)"""


@query("flt_05_shadow", f"with {_TWO} select id, rule, model, rule_conf, model_conf from t where model <> rule and rule_conf < 0.7 and coalesce(model_conf, 0.5) >= 0.3")
def shadow(spark, root):
    """FLT-05: rows on which an unsure rule and the model disagree, the least sure rule first."""
    t = _two_models(spark, root).where("model <> rule and rule_conf < 0.7 and coalesce(model_conf, 0.5) >= 0.3")
    return t.select("id", "rule", "model", "rule_conf", "model_conf").orderBy("rule_conf", F.desc("model_conf"), "id")


@query("flt_06_gates", f"""with {_TWO} select count(*) as n, count_if(model is not null) as has_model, count_if(model <> rule) as differs, count_if(rule_conf < 0.95) as rule_unsure, count_if(coalesce(model_conf, 0) >= 0.3) as model_sure,
    count_if(coalesce(model <> rule and rule_conf < 0.95 and model_conf >= 0.3, false)) as flips from t""")
def gates(spark, root):
    """FLT-06: how many rows pass each gate of a switch from rule to model, and all of them."""
    t, c = _two_models(spark, root), F.count_if
    flip = F.coalesce((F.col("model") != F.col("rule")) & (F.col("rule_conf") < 0.95) & (F.col("model_conf") >= 0.3), F.lit(False))
    return t.agg(F.count("*").alias("n"), c(F.col("model").isNotNull()).alias("has_model"), c(F.col("model") != F.col("rule")).alias("differs"), c(F.col("rule_conf") < 0.95).alias("rule_unsure"), c(F.coalesce("model_conf", F.lit(0)) >= 0.3).alias("model_sure"), c(flip).alias("flips"))


@query("prj_22_prod", f"with {_TWO} select id, case when model is not null and model <> rule and rule_conf < 0.95 and model_conf >= 0.3 then model else rule end as prod from t")
def prod(spark, root):
    """PRJ-22: the model's label only where it is there, differs, the rule is unsure and the model is sure."""
    use = F.col("model").isNotNull() & (F.col("model") != F.col("rule")) & (F.col("rule_conf") < 0.95) & (F.col("model_conf") >= 0.3)
    return _two_models(spark, root).select("id", F.when(use, F.col("model")).otherwise(F.col("rule")).alias("prod"))


@query("flt_08_receipts", "select id, amount from canonical_records where source = 'receipt' and trim(merchant_raw, ' ') <> '' and amount > 0")
def receipts(spark, root):
    """FLT-08: receipts with a name and a positive total."""
    return canonical(spark, root).where("source = 'receipt' and trim(merchant_raw) <> '' and amount > 0").select("id", "amount")


@query("flt_09_queue", f"select id, {_EFFECTIVE} as category, confidence from canonical_records where (confidence between 0.3 and 0.8 or confidence is null) and contains(lower(merchant_raw), 'bakery')")
def review_filter(spark, root):
    """FLT-09: a review queue by range of confidence or none, and by part of the name as plain text."""
    c = canonical(spark, root).where((F.col("confidence").between(0.3, 0.8) | F.col("confidence").isNull()) & F.contains(F.lower("merchant_raw"), F.lit("bakery")))
    return c.select("id", _effective().alias("category"), "confidence")


@query("flt_10_natural", "select coalesce(lower(trim(source, ' ')) <> 'synthetic_gapfill', true) as natural, count(*) as n from staging_transactions group by 1")
def natural(spark, root):
    """FLT-10: natural and synthetic rows."""
    return staging(spark, root).groupBy(F.coalesce(F.lower(F.trim("source")) != "synthetic_gapfill", F.lit(True)).alias("natural")).agg(F.count("*").alias("n"))


@query("top_12_queue", "select id, transaction_date, confidence from canonical_records order by transaction_date desc nulls last, confidence asc nulls last, id limit 200")
def queue(spark, root):
    """TOP-12: the first 200 of the review queue, newest and least certain first (a top-k report)."""
    c = canonical(spark, root).orderBy(F.desc_nulls_last("transaction_date"), F.asc_nulls_last("confidence"), "id")
    return c.limit(200).select("id", "transaction_date", "confidence")


@query("top_11_errors", f"with {_TWO} select id, truth, rule, model, model_conf from t where model <> truth order by model_conf asc nulls last, id limit 100")
def errors(spark, root):
    """TOP-11: the hundred wrong predictions of least confidence, unknown confidence last (a top-k report)."""
    t = _two_models(spark, root).where("model <> truth").select("id", "truth", "rule", "model", "model_conf")
    return t.orderBy(F.asc_nulls_last("model_conf"), "id").limit(100)


# ---- gold governance ---------------------------------------------------------------------------------------------------

_GOLDCAT = "coalesce(nullif(trim(tax_category_v1, ' '), ''), nullif(trim(category_final, ' '), ''))"


def _gold_category():
    return F.coalesce(blank("tax_category_v1"), blank("category_final"))


@query("flt_01_human", f"select count_if(coalesce({_pay('label_source')} = 'human' and {_GOLDCAT} is not null, false)) as kept, count_if(not coalesce({_pay('label_source')} = 'human' and {_GOLDCAT} is not null, false)) as skipped from gold_transactions")
def human(spark, root):
    """FLT-01: rows labelled by a person, and how many are not."""
    ok = F.coalesce((payload("label_source") == "human") & _gold_category().isNotNull(), F.lit(False))
    return gold(spark, root).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


@query("prj_12_labels", "select id, case when lower(trim(label_confidence, ' ')) in ('high', 'medium', 'low') then lower(trim(label_confidence, ' ')) else 'medium' end as label_confidence, coalesce(trim(label_notes, ' '), '') as label_notes from gold_transactions")
def labels(spark, root):
    """PRJ-12: confidence of a label as high, medium or low (medium if unknown), notes without surrounding space."""
    c = F.lower(F.trim("label_confidence"))
    return gold(spark, root).select("id", F.when(c.isin("high", "medium", "low"), c).otherwise("medium").alias("label_confidence"), F.coalesce(F.trim("label_notes"), F.lit("")).alias("label_notes"))


@query("prj_13_gold_category", f"select id, {_GOLDCAT} as category, coalesce({_pay('label_source')}, 'unknown') as label_source from gold_transactions")
def gold_category(spark, root):
    """PRJ-13: category and label source of a gold row."""
    return gold(spark, root).select("id", _gold_category().alias("category"), F.coalesce(payload("label_source"), F.lit("unknown")).alias("label_source"))


@query("prj_11_canonical_gold", f"""select id, case when lower(trim(direction, ' ')) in ('income', 'expense') then lower(trim(direction, ' ')) when {_GOLDCAT} = 'Income' then 'income' else 'expense' end as direction, nullif(trim(merchant_raw, ' '), '') as merchant_raw,
    {_MONEY.format('abs(amount)')} as amount, {_GOLDCAT} as category from gold_transactions""")
def canonical_gold(spark, root):
    """PRJ-11: gold rows in canonical form: direction, amount without sign, trimmed name, category."""
    d = F.lower(F.trim("direction"))
    way = F.when(d.isin("income", "expense"), d).when(_gold_category() == "Income", "income").otherwise("expense")
    return gold(spark, root).select("id", way.alias("direction"), blank("merchant_raw").alias("merchant_raw"), F.abs("amount").cast("decimal(18,2)").cast("string").alias("amount"), _gold_category().alias("category"))


@query("snk_14_gold_append", f"""with s as (select id, case when ingest_batch <= 5 then 'existing' when coalesce({_pay('label_source')}, '') <> 'human' then 'not_human' when coalesce({_GOLDCAT} in {_IN}, false) then 'appended' else 'invalid' end as status from gold_transactions)
    select status, count(*) as n from s group by 1 union all select 'in_store', count_if(status in ('existing', 'appended')) from s""")
def gold_append(spark, root):
    """SNK-14, GLD-02, JON-08: labelled rows appended to a store that has some: only new, human and valid ones; what became of each, counted."""
    g = gold(spark, root).select("id", "ingest_batch", payload("label_source").alias("label_source"), _gold_category().alias("category"))
    with Scratch(spark, "gold") as scratch:
        path = f"{scratch.folder}/gold"
        g.where("ingest_batch <= 5").select("id", "category").write.json(path)
        known = spark.read.schema("id string, category string").json(path).select("id", F.lit(True).alias("there")).distinct()
        status = F.when(F.col("there"), "existing").when(F.coalesce("label_source", F.lit("")) != "human", "not_human").when(F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)), "appended").otherwise("invalid")
        judged = scratch.written(g.join(known, "id", "left").withColumn("status", status), "judged")
        judged.where("status = 'appended'").select("id", "category").write.mode("append").json(path)
        total = spark.read.schema("id string, category string").json(path).agg(F.count("*").alias("n")).select(F.lit("in_store").alias("status"), "n")
        return written(judged.groupBy("status").agg(F.count("*").alias("n")).unionByName(total), "counters")


@query("agg_10_distribution", f"with {_TWO} select 'rule' as side, coalesce(nullif(trim(rule), ''), '<blank>') as label, count(*) as n from t group by 1, 2 union all select 'model', coalesce(nullif(trim(model), ''), '<blank>'), count(*) from t group by 1, 2")
def distribution(spark, root):
    """AGG-10: labels of both models, blank ones named."""
    t = _two_models(spark, root).select(F.explode(F.array(F.struct(F.lit("rule").alias("side"), F.col("rule").alias("l")), F.struct(F.lit("model").alias("side"), F.col("model").alias("l")))).alias("x"))
    return t.groupBy("x.side", F.coalesce(blank("x.l"), F.lit("<blank>")).alias("label")).agg(F.count("*").alias("n"))


@query("agg_23_routing", f"with {_TWO} select round(avg(cast(rule_conf >= 0.85 as double)), 6) as coverage, round(avg(cast(rule = 'Other Expense' as double)), 6) as other_rate, count(*) as n from t")
def routing(spark, root):
    """AGG-23: share of rows that the rule decides alone, and that fall into the rest."""
    t = _two_models(spark, root)
    return t.agg(F.round(F.avg((F.col("rule_conf") >= 0.85).cast("double")), 6).alias("coverage"), F.round(F.avg((F.col("rule") == "Other Expense").cast("double")), 6).alias("other_rate"), F.count("*").alias("n"))


@query("agg_27_progress", "select coalesce(category_final, 'Unlabeled') as category, count(*) as n, count(*) >= 200 as reached from gold_transactions group by 1")
def progress(spark, root):
    """AGG-27: labelled rows per category against a target of 200."""
    g = gold(spark, root).groupBy(F.coalesce("category_final", F.lit("Unlabeled")).alias("category")).agg(F.count("*").alias("n"))
    return g.withColumn("reached", F.col("n") >= 200)


@query("agg_15_two_models", f"""with {_TWO} select least, round(avg(cast(coalesce(case when rule_conf >= least then rule else coalesce(model, rule) end = truth, false) as double)), 6) as accuracy,
    count_if(rule_conf >= least) as by_rule from t, (select unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as least) group by 1""")
def two_models(spark, root):
    """AGG-15: accuracy of rule and model together at eight thresholds, in one pass."""
    t = _two_models(spark, root).withColumn("least", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)])))
    right = F.coalesce(rules.routed(F.col("rule"), F.col("rule_conf"), F.col("model"), F.col("least")) == F.col("truth"), F.lit(False))
    return t.groupBy("least").agg(F.round(F.avg(right.cast("double")), 6).alias("accuracy"), F.count_if(F.col("rule_conf") >= F.col("least")).alias("by_rule"))


_GRID = "(select unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])::double as rule_t) a, (select unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::double as model_t) b, (select unnest(['below', 'differs', 'always']) as policy) c"


@query("agg_16_three_policies", f"""with {_TWO}, x as (select *, coalesce(rule_conf < rule_t and model_conf >= model_t and model is not null, false) as unsure, coalesce(model_conf >= model_t and model is not null, false) as sure from t, {_GRID}),
    y as (select *, case when policy = 'always' then sure when policy = 'differs' then unsure and model <> rule else unsure end as flip from x)
    select policy, rule_t, model_t, round(avg(cast(coalesce(case when flip then model else rule end = truth, false) as double)), 6) as accuracy, round(avg(cast(coalesce(case when flip then model else rule end = truth, false) as double)) - avg(cast(coalesce(rule = truth, false) as double)), 6) as delta, count_if(flip) as flips from y group by 1, 2, 3""")
def three_policies(spark, root):
    """AGG-16: three policies on a grid of nine by seven thresholds: accuracy, difference to the rule alone, flips."""
    t = _two_models(spark, root)
    for name, values in (("rule_t", (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)), ("model_t", (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)), ("policy", ("below", "differs", "always"))):
        t = t.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    sure = F.coalesce((F.col("model_conf") >= F.col("model_t")) & F.col("model").isNotNull(), F.lit(False))
    both = sure & F.coalesce(F.col("rule_conf") < F.col("rule_t"), F.lit(False))
    flip = F.when(F.col("policy") == "always", sure).when(F.col("policy") == "differs", both & (F.col("model") != F.col("rule"))).otherwise(both)
    right = lambda c: F.avg(F.coalesce(c == F.col("truth"), F.lit(False)).cast("double"))
    mixed = right(F.when(flip, F.col("model")).otherwise(F.col("rule")))
    return t.groupBy("policy", "rule_t", "model_t").agg(F.round(mixed, 6).alias("accuracy"), F.round(mixed - right(F.col("rule")), 6).alias("delta"), F.count_if(flip).alias("flips"))


@query("agg_04_ambiguous", "select coalesce(merchant_norm, merchant_raw, '') as merchant, count(*) as n, round(avg(coalesce(confidence, 0)), 6) as confidence from canonical_records group by 1 having count(*) >= 1 order by avg(coalesce(confidence, 0)), n desc, merchant limit 10")
def ambiguous(spark, root):
    """AGG-04: the ten merchants of least average confidence (a top-k report)."""
    c = canonical(spark, root).groupBy(F.coalesce("merchant_norm", "merchant_raw", F.lit("")).alias("merchant")).agg(F.count("*").alias("n"), F.avg(F.coalesce("confidence", F.lit(0))).alias("mean"))
    return c.where("n >= 1").orderBy("mean", F.desc("n"), "merchant").limit(10).select("merchant", "n", F.round("mean", 6).alias("confidence"))


@query("agg_03_summary", """select count(*) as total_records, count_if(source = 'receipt') as total_receipts, count_if(source = 'receipt' and matched_transaction_id is not null) as matched_receipts,
    round(coalesce(count_if(source = 'receipt' and matched_transaction_id is not null) / nullif(count_if(source = 'receipt'), 0), 0), 6) as match_rate, round(avg(confidence), 6) as avg_confidence,
    count_if(nullif(trim(category_final, ' '), '') is null and confidence < 0.7) as low_confidence_queue_size, count_if(category_pred <> category_final) as conflicts_queue_size from canonical_records""")
def summary(spark, root):
    """AGG-03: the counters of the reconciliation summary in one pass."""
    r = F.col("source") == "receipt"
    m = F.count_if(r & F.col("matched_transaction_id").isNotNull())
    return canonical(spark, root).agg(
        F.count("*").alias("total_records"), F.count_if(r).alias("total_receipts"), m.alias("matched_receipts"), F.round(F.coalesce(m / F.nullif(F.count_if(r), F.lit(0)), F.lit(0.0)), 6).alias("match_rate"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.count_if(blank("category_final").isNull() & (F.col("confidence") < 0.7)).alias("low_confidence_queue_size"), F.count_if(F.col("category_pred") != F.col("category_final")).alias("conflicts_queue_size"),
    )


# ---- samplers ----------------------------------------------------------------------------------------------------------


@query("top_09_sparse", f"""with s as (select rowid, category_external as target, {_FLAGS} from staging_transactions where category_external is not null), t as (select rowid, target, 2 * missing_mcc + missing_description + 3 * merchant_only + generic_description as score from s)
    select rowid, target, score from (select *, row_number() over (partition by target order by score desc, rowid) as n from t where score > 0) where n <= 25""")
def sparse(spark, root):
    """TOP-09: for every target the 25 rows with most missing, if any is (a batch sampler)."""
    s = _flags(staging(spark, root).where("category_external is not null"))
    t = s.select("rowid", F.col("category_external").alias("target"), F.expr("2 * missing_mcc + missing_description + 3 * merchant_only + generic_description").alias("score")).where("score > 0")
    return sampling.per_group(t, "target", [F.desc("score"), F.col("rowid")], 25)


@query("top_10_balance", """with b as (select rowid, case when lower(source) like '%card%' then 'bank' when lower(source) like 'eu%' then 'toast' else 'other' end as bucket, abs(amount) as size from staging_transactions where amount is not null)
    select rowid, bucket from (select *, row_number() over (partition by bucket order by size desc, rowid) as n from b) where n <= case bucket when 'bank' then 60 when 'toast' then 40 else 0 end""")
def balance(spark, root):
    """TOP-10: a number of rows from each bucket of sources, the largest amounts first (a batch sampler)."""
    b = bucket(spark, root).join(staging(spark, root).where("amount is not null").select("rowid", F.abs("amount").alias("size")), "rowid")
    quota = F.when(F.col("bucket") == "bank", 60).when(F.col("bucket") == "toast", 40)
    ranked = b.where(quota.isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("size"), "rowid")))
    return ranked.where(F.col("n") <= quota).select("rowid", "bucket")


@query("top_15_support", """with g as (select id, category_final as label, md5('3|' || id) as h from gold_transactions where category_final is not null), r as (select *, row_number() over (partition by label order by h, id) as n from g)
    select id, label, case when n <= 5 or md5('7|' || id) < '2' then 'test' else 'train' end as split from r""")
def support(spark, root):
    """TOP-15: a split in which every label has at least five test rows."""
    g = gold(spark, root).where("category_final is not null").select("id", F.col("category_final").alias("label"))
    return sampling.supported(g, "id", "label", 5, 0.125, (3, 7))


@query("top_17_locked", "select id, case when md5('5|' || id) < '4' then 'test' else 'train' end as split from gold_transactions")
def locked(spark, root):
    """TOP-17: a split made once and stored, replayed for the same rows; other rows would be an error."""
    g = gold(spark, root).select("id")
    with Scratch(spark, "locked") as scratch:
        sampling.locked_split(g, "id", f"{scratch.folder}/split", 5, 0.25)
        return written(sampling.locked_split(g, "id", f"{scratch.folder}/split", 99, 0.9), "locked")


@query("set_05_subset", f"select c as label, c in (select category_final from gold_transactions where category_final is not null) as known from (select unnest({CATEGORIES}) as c)")
def subset(spark, root):
    """SET-05: which of the expected labels the labelled rows have."""
    have = gold(spark, root).where("category_final is not null").select(F.col("category_final").alias("label")).distinct().withColumn("known", F.lit(True))
    want = spark.createDataFrame([(c,) for c in CATEGORIES], "label string")
    return want.join(have, "label", "left").withColumn("known", F.coalesce("known", F.lit(False)))


# ---- small functions ---------------------------------------------------------------------------------------------------


@query("str_16_formats", """select id, case when amount is null then '' else '$' || format('{:,.2f}', cast(amount as decimal(18,2))::double) end as money, case when confidence is null then '' else cast(cast(round(confidence * 100) as int) as varchar) || '%' end as percent,
    case when confidence >= 0.85 then 'high' when confidence >= 0.6 then 'medium' else 'low' end as level from canonical_records""")
def formats(spark, root):
    """STR-16: money, percent and level as a reader sees them."""
    level = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    dollars = F.concat(F.lit("$"), F.format_number(F.col("amount").cast("decimal(18,2)"), 2))
    percent = F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    return canonical(spark, root).select("id", F.coalesce(dollars, F.lit("")).alias("money"), F.coalesce(percent, F.lit("")).alias("percent"), level.alias("level"))


@query("str_17_lines", r"select count(*) as n_lines from (select unnest(string_split_regex(text, '\r?\n')) as line from documents where source = 'ledger_memo') where trim(line, ' ') <> ''")
def line_count(spark, root):
    """STR-17: lines that aren't blank."""
    d = table(spark, root, "documents").where("source = 'ledger_memo'").select(F.explode(F.split("text", r"\r?\n")).alias("line"))
    return d.where(F.trim("line") != "").agg(F.count("*").alias("n_lines"))


@query("str_08_sep", f"select id, trim(coalesce(nullif(trim(merchant_raw, ' '), ''), '') || ' [SEP] ' || coalesce({_pay('description')}, ''), ' ') as text from gold_transactions")
def separated(spark, root):
    """STR-08: merchant and description with a mark between them."""
    return gold(spark, root).select("id", F.trim(F.concat(F.coalesce(blank("merchant_raw"), F.lit("")), F.lit(" [SEP] "), F.coalesce(payload("description"), F.lit("")))).alias("text"))


@query("dat_04_dates", r"""select id, cast(coalesce(try_strptime(case when regexp_full_match(substr(transaction_date, 1, 10), '\d{4}-\d{2}-\d{2}') then substr(transaction_date, 1, 10) end, '%Y-%m-%d'),
    try_strptime(case when regexp_full_match(substr(transaction_date, 1, 10), '\d{4}/\d{2}/\d{2}') then substr(transaction_date, 1, 10) end, '%Y/%m/%d')) as date) as day from canonical_records""")
def dates(spark, root):
    """DAT-04: the first ten letters as yyyy-mm-dd or yyyy/mm/dd."""
    ten = F.left("transaction_date", F.lit(10))
    slashed = F.when(ten.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.replace(ten, F.lit("/"), F.lit("-")))
    return canonical(spark, root).select("id", F.coalesce(F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), ten), slashed).try_cast("date").alias("day"))


_CADENCE = "['weekly', 'biweekly', 'monthly', 'quarterly', 'irregular']"


@query("dat_05_cadence", f"""with g as (select id, cast(transaction_date as date) as d, ({_CADENCE})[1 + length(id || coalesce(merchant_raw, '')) % 5] as cadence from gold_transactions)
    select id, cadence, cast(case cadence when 'weekly' then d + interval 7 day when 'biweekly' then d + interval 14 day when 'monthly' then d + interval 1 month when 'quarterly' then d + interval 3 month else d + interval 10 day end as date) as next_day from g""")
def cadence(spark, root):
    """DAT-05: the next date of a row by its cadence, at the end of a month where the day doesn't exist."""
    names = F.array(*[F.lit(x) for x in ("weekly", "biweekly", "monthly", "quarterly", "irregular")])
    g = gold(spark, root).select("id", F.to_date("transaction_date").alias("d"), F.get(names, F.length(F.concat("id", F.coalesce("merchant_raw", F.lit("")))) % 5).alias("cadence"))
    step = F.when(F.col("cadence") == "weekly", F.date_add("d", 7)).when(F.col("cadence") == "biweekly", F.date_add("d", 14)).when(F.col("cadence") == "monthly", F.add_months("d", 1)).when(F.col("cadence") == "quarterly", F.add_months("d", 3))
    return g.select("id", "cadence", F.coalesce(step, F.date_add("d", 10)).alias("next_day"))


@query("num_03_signs", r"""select 'toast' as feed, record_id, abs(try_cast(total as double)) as amount, case when try_cast(total as double) >= 0 then 'income' else 'expense' end as direction from toast_sample where regexp_full_match(total, '-?\d+(\.\d+)?')
    union all select 'quickbooks', record_id, abs(try_cast("Amount" as double)), case when try_cast("Amount" as double) < 0 then 'expense' else 'income' end from quickbooks_sample where regexp_full_match("Amount", '-?\d+(\.\d+)?')""")
def signs(spark, root):
    """NUM-03: magnitude and direction by the sign rule of each feed."""
    plain = r"^-?\d+(\.\d+)?$"
    one = lambda feed, name, c: table(spark, root, name).where(F.col(c).rlike(plain)).select(F.lit(feed).alias("feed"), "record_id", F.abs(F.col(c).cast("double")).alias("amount"), F.when(F.col(c).cast("double") < 0, "expense").otherwise("income").alias("direction"))
    return one("toast", "toast_sample", "total").unionByName(one("quickbooks", "quickbooks_sample", "Amount"))


@query("num_06_rule_bins", "select case when confidence is null then 'none' when confidence >= 0.9 then '0.90+' when confidence >= 0.75 then '0.75-0.89' when confidence >= 0.5 then '0.50-0.74' else '<0.50' end as bin, count(*) as n from canonical_records group by 1")
def rule_bins(spark, root):
    """NUM-06: the second scheme of confidence bins."""
    c = F.col("confidence")
    bins = F.when(c.isNull(), "none").when(c >= 0.9, "0.90+").when(c >= 0.75, "0.75-0.89").when(c >= 0.5, "0.50-0.74").otherwise("<0.50")
    return canonical(spark, root).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


@query("jon_06_matcher", """with c as (select id, source, try_cast(transaction_date as date) as d, amount, upper(trim(merchant_raw, ' ')) as m from canonical_records where regexp_full_match(transaction_date, '\\d{4}-\\d{2}-\\d{2}') and amount is not null),
    x as (select r.id as receipt, b.id as bank, 0.3 * greatest(0.0, 1 - abs(r.d - b.d) / 3.0) + 0.4 * greatest(0.0, 1 - abs(r.amount - b.amount) / 10.0) + 0.3 * greatest(0.0, case when r.m is null or b.m is null or greatest(length(r.m), length(b.m)) = 0 then 0.0 else 1 - levenshtein(r.m, b.m) / greatest(length(r.m), length(b.m)) end - 0.2) as score
      from c r join c b on r.source = 'receipt' and b.source = 'bank' and abs(r.d - b.d) <= 2 and abs(r.amount - b.amount) < 10),
    p as (select receipt, arg_min(bank, (-round(score, 9), bank)) as bank from x where score > 0.6 group by 1), t as (select id as receipt, matched_transaction_id as bank from canonical_records where source = 'receipt' and matched_transaction_id is not null),
    j as (select count(p.receipt) as n_predicted, count(t.receipt) as n_true, count_if(p.bank = t.bank) as tp from p full outer join t on p.receipt = t.receipt and p.bank = t.bank)
    select n_predicted, n_true, tp, round(tp / n_predicted, 6) as precision, round(tp / n_true, 6) as recall, round(2.0 * tp / (n_predicted + n_true), 6) as f1 from j""")
def matcher(spark, root):
    """JON-06: a matcher with weights of its own, and precision, recall and F1 of its pairs against the stored links.

    Pairs meet on day (spread over two days around) and amount in steps of ten
    (its own and the two beside it), so no day's rows are held against all others.
    """
    c = canonical(spark, root).where(F.col("transaction_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("amount").isNotNull())
    c = c.select("id", "source", F.col("transaction_date").try_cast("date").alias("d"), "amount", F.upper(F.trim("merchant_raw")).alias("m"))
    r = c.where("source = 'receipt' and d is not null").select(F.col("id").alias("receipt"), F.col("d").alias("rd"), F.col("amount").alias("ra"), F.col("m").alias("rm"), F.floor(F.col("amount") / 10).alias("step"))
    r = r.withColumn("d", F.explode(F.sequence(F.date_sub("rd", 2), F.date_add("rd", 2)))).withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    b = c.where("source = 'bank'").select(F.col("id").alias("bank"), "d", "amount", "m", F.floor(F.col("amount") / 10).alias("step"))
    x = r.join(b, ["d", "step"]).where(F.abs(F.col("ra") - F.col("amount")) < 10)
    most = F.greatest(F.length("rm"), F.length("m"))
    alike = F.coalesce(F.when(most > 0, 1 - F.levenshtein("rm", "m") / most), F.lit(0.0))
    score = 0.3 * F.greatest(F.lit(0.0), 1 - F.abs(F.datediff("rd", "d")) / 3.0) + 0.4 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("ra") - F.col("amount")) / 10.0) + 0.3 * F.greatest(F.lit(0.0), alike - 0.2)
    p = x.withColumn("score", score).where("score > 0.6").groupBy("receipt").agg(F.min_by("bank", F.struct(-F.round("score", 9), "bank")).alias("bank"))
    t = canonical(spark, root).where("source = 'receipt' and matched_transaction_id is not null").select(F.col("id").alias("receipt"), F.col("matched_transaction_id").alias("bank"))
    j = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["receipt", "bank"], "full_outer")
    s = j.agg(F.count("p").alias("n_predicted"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    return s.select("*", F.round(F.col("tp") / F.col("n_predicted"), 6).alias("precision"), F.round(F.col("tp") / F.col("n_true"), 6).alias("recall"), F.round(2.0 * F.col("tp") / (F.col("n_predicted") + F.col("n_true")), 6).alias("f1"))


@query("gen_02_negatives", """with r as (select id, amount, cast(transaction_date as date) as d, merchant_raw, md5('neg|' || id) as h from gold_transactions where source = 'receipt' and amount > 0)
    select id, case when h < '5' then 'amount' when h < 'a' then 'date' else 'merchant' end as mode, cast(case when h < '5' then amount * 2 + 25 else amount end as decimal(18,2)) as bank_amount, cast(case when h >= '5' and h < 'a' then d + interval 30 day else d end as date) as bank_day,
      case when h < 'a' then merchant_raw else 'UNRELATED ' || upper(substr(h, 1, 6)) end as bank_merchant, false as should_match from r where substr(h, 32, 1) < '5'""")
def negatives(spark, root):
    """GEN-02: bank rows that must not match a receipt: another amount, a far date or another name, for about three receipts in ten."""
    h = F.md5(F.concat(F.lit("neg|"), "id"))
    r = gold(spark, root).where("source = 'receipt' and amount > 0").select("id", "amount", F.to_date("transaction_date").alias("d"), "merchant_raw", h.alias("h"))
    mode = F.when(F.col("h") < "5", "amount").when(F.col("h") < "a", "date").otherwise("merchant")
    return r.where(F.substr("h", F.lit(32), F.lit(1)) < "5").select(
        "id", mode.alias("mode"), F.when(F.col("h") < "5", F.col("amount") * 2 + 25).otherwise(F.col("amount")).cast("decimal(18,2)").alias("bank_amount"), F.when((F.col("h") >= "5") & (F.col("h") < "a"), F.date_add("d", 30)).otherwise(F.col("d")).alias("bank_day"),
        F.when(F.col("h") < "a", F.col("merchant_raw")).otherwise(F.concat(F.lit("UNRELATED "), F.upper(F.left("h", F.lit(6))))).alias("bank_merchant"), F.lit(False).alias("should_match"),
    )


@query("mlx_12_select", "select rowid, confidence from (select id as rowid, confidence from canonical_records where category_final is null and confidence is not null) order by confidence, rowid limit 80")
def selection(spark, root):
    """MLX-12: the 80 unlabelled rows of least confidence (a selection for labelling)."""
    c = canonical(spark, root).where("category_final is null and confidence is not null")
    return c.select(F.col("id").alias("rowid"), "confidence").orderBy("confidence", "rowid").limit(80)
