"""Reports, batches by pattern, policy sweeps, exports as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, sampling
from ledgerloom.plans.record_queries import _EFFECTIVE, _effective
from ledgerloom.runtime import table
from ledgerloom.sources import writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Example targets of this repository's batches: name, pattern.
TARGETS = (("repairs", "PLUMB|ROOF|ELECTRIC|REPAIR"), ("food", "BAKERY|COFFEE|NOODLE|SEAFOOD|BREW"), ("learning", "COLLEGE|UNIVERSITY|TRAINING"))


def _target():
    c = F.lit(None).cast("string")
    upper = F.upper(F.concat_ws(" ", "merchant_raw", "description", "mcc_description"))
    for name, pattern in reversed(TARGETS):
        c = F.when(upper.rlike(pattern), name).otherwise(c)
    return c


_TARGET = "case " + " ".join(f"when regexp_matches(upper(concat_ws(' ', merchant_raw, description, mcc_description)), '{p}') then '{n}'" for n, p in TARGETS) + " end"


@query("top_06_targets", f"""
    with t as (select rowid, {_TARGET} as target, (case when mcc is null then 1 else 0 end + case when category_external is null then 2 else 0 end) as score from staging_transactions)
    select rowid, target, score from (select *, row_number() over (partition by target order by score desc, rowid) as n from t where target is not null) where n <= 40""")
def targets(spark, root):
    """TOP-06..10: the 40 best rows for each target pattern (a batch sampler)."""
    score = F.when(F.col("mcc").isNull(), 1).otherwise(0) + F.when(F.col("category_external").isNull(), 2).otherwise(0)
    t = table(spark, root, "staging_transactions").select("rowid", _target().alias("target"), score.alias("score")).where("target is not null")
    return sampling.per_group(t, "target", [F.desc("score"), F.col("rowid")], 40)


@query("top_08_slices", f"""
    with t as (select rowid, {_TARGET} as target, mcc from staging_transactions), a as (select rowid from t where target = 'food' order by rowid limit 50),
    b as (select rowid from t where mcc is null and rowid not in (select rowid from a) order by rowid limit 50)
    select rowid, 'food' as slice from a union all select rowid, 'no_mcc' from b""")
def slices(spark, root):
    """TOP-08: slices picked one after the other, each from what is left (a batch sampler)."""
    t = table(spark, root, "staging_transactions").select("rowid", "mcc", _target().alias("target"))
    a = t.where("target = 'food'").orderBy("rowid").limit(50).select("rowid")
    b = t.where("mcc is null").join(a, "rowid", "left_anti").orderBy("rowid").limit(50).select("rowid")
    return a.withColumn("slice", F.lit("food")).unionByName(b.withColumn("slice", F.lit("no_mcc")))


@query("agg_18_per_truth", "select category_final as truth, count(*) as n, round(avg(case when coalesce(category_pred = category_final, false) then 1.0 else 0.0 end), 6) as hit_rate from gold_transactions where category_final is not null group by 1")
def per_truth(spark, root):
    """AGG-18: hit rate of every true label, rows without prediction counted as misses."""
    g = table(spark, root, "gold_transactions").where("category_final is not null")
    hit = F.coalesce(F.col("category_pred") == F.col("category_final"), F.lit(False)).cast("double")
    return g.groupBy(F.col("category_final").alias("truth")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("hit_rate"))


@query("agg_17_fill_rates", "select source, round(avg(case when merchant_norm is not null then 1.0 else 0.0 end), 6) as norm_rate, round(avg(case when category_final is not null then 1.0 else 0.0 end), 6) as final_rate, round(avg(case when payment_method is not null then 1.0 else 0.0 end), 6) as method_rate from canonical_records group by 1")
def fill_rates(spark, root):
    """AGG-17: share of filled fields per source."""
    rate = lambda c, n: F.round(F.avg(F.col(c).isNotNull().cast("double")), 6).alias(n)
    return table(spark, root, "canonical_records").groupBy("source").agg(rate("merchant_norm", "norm_rate"), rate("category_final", "final_rate"), rate("payment_method", "method_rate"))


@query("agg_20_lines", r"select feed, case when raw_text like '%' || chr(10) || '%' then 'multi' else 'single' end as kind, count(*) as n, sum(length(raw_text)) as chars from raw_records group by 1, 2")
def lines(spark, root):
    """AGG-20: records per feed and kind."""
    r = table(spark, root, "raw_records")
    kind = F.when(F.contains("raw_text", F.lit("\n")), "multi").otherwise("single")
    return r.groupBy("feed", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("raw_text")).alias("chars"))


@query("agg_21_spend", f"select {_EFFECTIVE} as category, sum(cast(amount as decimal(18,2))) as spend, count(*) as n, round(avg(confidence), 6) as confidence from canonical_records where direction = 'expense' group by 1 order by spend desc, category limit 10")
def spend(spark, root):
    """AGG-21: the ten categories of most spend (a top-k report)."""
    c = table(spark, root, "canonical_records").where("direction = 'expense'").groupBy(_effective().alias("category"))
    c = c.agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("spend"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return c.orderBy(F.desc("spend"), "category").limit(10)


@query("agg_25_errors", "select category_final || ' -> ' || category_pred as error, count(*) as n from gold_transactions where category_final <> category_pred group by 1")
def errors(spark, root):
    """AGG-25: error types counted."""
    g = table(spark, root, "gold_transactions").where("category_final <> category_pred")
    return g.groupBy(F.concat_ws(" -> ", "category_final", "category_pred").alias("error")).agg(F.count("*").alias("n"))


@query("agg_09_cube", "select source, direction, grouping_id(source, direction) as level, count(*) as n, sum(cast(amount as decimal(18,2))) as amount from canonical_records group by cube (source, direction)")
def cube(spark, root):
    """CUBE over source and direction, the natural form of the sliced reports."""
    return table(spark, root, "canonical_records").cube("source", "direction").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))


@query("str_09_features", """
    select id, concat_ws(' ', nullif(trim(merchant_raw, ' '), ''), nullif(trim(case when json_valid(raw_payload) then json_extract_string(raw_payload, '$.description') end), ''),
      case when json_valid(raw_payload) and nullif(trim(json_extract_string(raw_payload, '$.mcc')), '') is not null then 'has_mcc' else 'missing_mcc' end,
      case when amount < 25 then 'amount_small' when amount < 250 then 'amount_medium' when amount >= 250 then 'amount_large' end) as features from gold_transactions""")
def features(spark, root):
    """STR-08..09: feature text of a record."""
    p = lambda f: F.nullif(F.trim(F.get_json_object("raw_payload", f"$.{f}")), F.lit(""))
    a = F.col("amount")
    size = F.when(a < 25, "amount_small").when(a < 250, "amount_medium").when(a >= 250, "amount_large")
    return table(spark, root, "gold_transactions").select("id", F.concat_ws(" ", F.nullif(F.trim("merchant_raw"), F.lit("")), p("description"), F.when(p("mcc").isNotNull(), "has_mcc").otherwise("missing_mcc"), size).alias("features"))


@query("snk_05_import", f"select coalesce(transaction_date, '') as \"Date\", coalesce(merchant_raw, '') as \"Description\", amount as \"Amount\", coalesce(merchant_norm, merchant_raw, '') as \"Payee\", {_EFFECTIVE} as \"Category\", coalesce(source_record_id, '') as \"Memo\" from canonical_records")
def import_table(spark, root):
    """SNK-05, SNK-11: the columns of a ledger import."""
    return writers.import_lines(table(spark, root, "canonical_records"), _effective())


@query("snk_09_audit", "select id, source, matched_transaction_id as matched, category_final as final from canonical_records")
def audit(spark, root):
    """SNK-09: audit objects, read back from their JSON."""
    c = table(spark, root, "canonical_records")
    j = writers.audit_lines(c, "run").select("value")
    get = lambda p: F.get_json_object("value", p)
    return j.select(get("$.transaction_id").alias("id"), get("$.inputs.source").alias("source"), get("$.match_scores.matched_transaction_id").alias("matched"), get("$.final_decision.category_final").alias("final"))


@query("gld_01_merge", """
    with f as (select id, lower(trim(merchant_raw, ' ')) || '|' || coalesce(cast(cast(amount as decimal(18,2)) as varchar), '') as fp from gold_transactions),
    k as (select distinct lower(trim(merchant_raw, ' ')) || '|' || coalesce(cast(cast(amount as decimal(18,2)) as varchar), '') as fp from canonical_records where merchant_raw is not null)
    select fp, min(id) as id from f where fp not in (select fp from k) group by 1""")
def merge(spark, root):
    """GLD-01: labelled rows that the store doesn't have by fingerprint, the first of each."""
    fp = F.concat_ws("|", F.lower(F.trim("merchant_raw")), F.coalesce(F.col("amount").cast("decimal(18,2)").cast("string"), F.lit("")))
    known = table(spark, root, "canonical_records").where("merchant_raw is not null").select(fp.alias("fp")).distinct()
    return table(spark, root, "gold_transactions").select("id", fp.alias("fp")).join(known, "fp", "left_anti").groupBy("fp").agg(F.min("id").alias("id"))


@query("evt_01_sessions", """
    with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as starts, event_id from events),
    s as (select user_id, ts, sum(starts) over (partition by user_id order by ts, event_id) as session from e)
    select user_id, count(distinct session) as n_sessions, count(*) as n_events from s group by 1""")
def sessions(spark, root):
    """Extension: sessions per user with a gap of 30 minutes."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, root, "events")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return e.withColumn("starts", F.when(gap <= 1800 * 1000000, 0).otherwise(1)).groupBy("user_id").agg(F.sum("starts").alias("n_sessions"), F.count("*").alias("n_events"))
