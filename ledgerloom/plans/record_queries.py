"""Filters, joins, aggregations, samples, splits and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, joins, ledger, rules, sampling, timestamps
from ledgerloom.runtime import table

# The category names, in their usual order.
CATEGORIES = [
    "Income", "COGS", "Rent & Utilities", "Repairs & Maintenance", "Office Supplies", "Equipment & Software", "Advertising & Marketing", "Travel", "Meals & Entertainment", "Vehicle Expenses",
    "Professional Services", "Financial Fees", "Insurance", "Taxes & Licenses", "Payroll & Contractors", "Education & Training", "Other Expense",
]
_IN = "(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _effective():
    valid = lambda c: F.when(F.col(c).isin(CATEGORIES), F.col(c))
    return F.coalesce(valid("category_final"), valid("category_pred"), F.lit("Other Expense"))


_EFFECTIVE = f"case when category_final in {_IN} then category_final when category_pred in {_IN} then category_pred else 'Other Expense' end"
_ACC = lambda x: f"round({x}, 6)"


@query("prj_03_effective", f"select id, {_EFFECTIVE} as effective, case when category_final is not null then 'human' when category_pred is not null then 'rules' else 'none' end as label_source from canonical_records")
def effective(spark, root):
    """PRJ-03..04: effective category and where it comes from."""
    source = F.when(F.col("category_final").isNotNull(), "human").when(F.col("category_pred").isNotNull(), "rules").otherwise("none")
    return table(spark, root, "canonical_records").select("id", _effective().alias("effective"), source.alias("label_source"))


@query("prj_20_double_entry", f"""
    select id, 1 as line, case when coalesce(lower(trim(direction)) = 'income', false) then 'Bank Clearing' else {_EFFECTIVE} end as account, amount as debit, cast(null as double) as credit from canonical_records where amount > 0
    union all select id, 2, case when coalesce(lower(trim(direction)) = 'income', false) then 'Income' else 'Bank Clearing' end, null, amount from canonical_records where amount > 0""")
def double_entry(spark, root):
    """PRJ-20: two ledger lines per row with a positive amount."""
    c = table(spark, root, "canonical_records").withColumn("account", _effective())
    return ledger.double_entry(c, "amount", "direction", F.col("account"), "Bank Clearing", "Income", ["id"])


@query("prj_21_routing", """
    with p as (select id, category_final as rule, confidence, category_pred as model from canonical_records)
    select id, case when confidence >= 0.85 then rule else coalesce(model, rule) end as t85, case when confidence >= 0.7 then rule else coalesce(model, rule) end as t70,
      case when model is not null and rule is not null and model <> rule and confidence < 0.95 then model else rule end as candidate from p""")
def routing(spark, root):
    """PRJ-21..23: rule or model label by confidence thresholds."""
    rule, model, conf = F.col("category_final"), F.col("category_pred"), F.col("confidence")
    flip = (model != rule) & (conf < 0.95)
    return table(spark, root, "canonical_records").select("id", rules.routed(rule, conf, model, 0.85).alias("t85"), rules.routed(rule, conf, model, 0.7).alias("t70"), F.when(flip, model).otherwise(rule).alias("candidate"))


@query("flt_02_low_confidence", "select id, confidence, transaction_date from canonical_records where coalesce(trim(category_final), '') = '' and confidence < 0.7")
def low_confidence(spark, root):
    """FLT-02: rows without a final label and with a low confidence."""
    c = table(spark, root, "canonical_records")
    return c.where((F.coalesce(F.trim("category_final"), F.lit("")) == "") & (F.col("confidence") < 0.7)).select("id", "confidence", "transaction_date")


@query("flt_03_unmatched_receipts", "select id, merchant_raw, amount from canonical_records where source = 'receipt' and matched_transaction_id is null")
def unmatched_receipts(spark, root):
    """FLT-03."""
    return table(spark, root, "canonical_records").where("source = 'receipt' and matched_transaction_id is null").select("id", "merchant_raw", "amount")


@query("flt_07_review_reasons", """
    select id, array_to_string(list_filter([case when confidence < 0.7 then 'low_confidence' end, case when category_pred <> category_final then 'conflict' end, case when match_score < 0.8 then 'weak_match' end], lambda x: x is not null), ',') as reasons
    from canonical_records where confidence < 0.7 or category_pred <> category_final or match_score < 0.8""")
def review_reasons(spark, root):
    """FLT-04..07: rows to review with every reason that applies."""
    r = F.array_compact(F.array(F.when(F.col("confidence") < 0.7, "low_confidence"), F.when(F.col("category_pred") != F.col("category_final"), "conflict"), F.when(F.col("match_score") < 0.8, "weak_match")))
    return table(spark, root, "canonical_records").select("id", F.array_join(r, ",").alias("reasons")).where("reasons <> ''")


def _sides(spark, root):
    c = table(spark, root, "canonical_records").where("transaction_date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'")
    c = c.select("id", "source", F.col("transaction_date").try_cast("date").alias("day"), "amount", F.lower(F.coalesce("merchant_norm", "merchant_raw")).alias("name"), F.col("id").alias("rank")).where("day is not null")
    return c.where("source = 'receipt'"), c.where("source <> 'receipt'")


def _all_sides(spark, root):
    """Receipts and other rows whatever the writing of their dates (in the order of their source); rows without a usable date have a null day."""
    home = table(spark, root, "source_profiles").select(F.col("source").alias("of"), "zone", "date_order")

    def side(rows):  # filtered first: parsing is the dear part, and no filter gets below it
        c = table(spark, root, "canonical_records").where(rows).join(F.broadcast(home), F.col("source") == F.col("of"), "left")
        c = timestamps.local_day(c, "transaction_date", "zone", "date_order")
        return c.select("id", "source", "day", "amount", F.lower(F.coalesce("merchant_norm", "merchant_raw")).alias("name"), F.col("id").alias("rank"))

    return side("source = 'receipt'"), side("source <> 'receipt'").where("day is not null")


@query("jon_01_best_match", r"""
    with c as (select id, source, try_cast(transaction_date as date) as day, amount, lower(coalesce(merchant_norm, merchant_raw)) as name from canonical_records where regexp_full_match(transaction_date, '\d{4}-\d{2}-\d{2}')),
    r as (select * from c where source = 'receipt' and day is not null), t as (select * from c where source <> 'receipt' and day is not null),
    m as (select r.id as left_id, t.id as rid, 0.3 * (1 - abs(date_diff('day', t.day, r.day)) / 3.0::double) + 0.5 * (1 - abs(r.amount - t.amount) / 10.0::double) + 0.2 * case when r.name = t.name then 1 else 0 end as score
          from r join t on t.day between r.day - 2 and r.day + 2 and abs(r.amount - t.amount) < 10),
    b as (select *, row_number() over (partition by left_id order by score desc, rid) as n from m)
    select r.id as left_id, case when b.score >= 0.75 then b.rid end as right_id, round(coalesce(b.score, 0), 6) as score from r left join b on b.left_id = r.id and b.n = 1""")
def best_match(spark, root):
    """JON-01..02: receipts to transactions by date, amount and equal names; as its SQL, only rows with a date written yyyy-MM-dd."""
    receipts, others = _sides(spark, root)
    m = joins.best_match(receipts, others, joins.equal_names)
    return m.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon_01_best_match_all")
def best_match_all(spark, root):
    """JON-01..02: the same for every receipt, whatever the writing of its date (no SQL)."""
    receipts, others = _all_sides(spark, root)
    m = joins.best_match(receipts, others, joins.equal_names)
    return m.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon_01_best_match_ratio")
def best_match_ratio(spark, root):
    """JON-01 and STR-13: every receipt with the Ratcliff-Obershelp ratio of the names (no SQL)."""
    receipts, others = _all_sides(spark, root)
    m = joins.best_match(receipts, others, joins.floored_ratio)
    return m.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("jon_03_candidates", r"""
    with c as (select id, source, try_cast(transaction_date as date) as day, amount from canonical_records where regexp_full_match(transaction_date, '\d{4}-\d{2}-\d{2}')),
    m as (select r.id as left_id, t.id as right_id, round(0.5 * (1 - abs(date_diff('day', t.day, r.day)) / 3.0::double) + 0.5 * (1 - abs(r.amount - t.amount) / 10.0::double), 6) as score
          from c r join c t on r.source = 'receipt' and t.source <> 'receipt' and t.day between r.day - 2 and r.day + 2 and abs(r.amount - t.amount) < 10),
    b as (select *, row_number() over (partition by left_id order by score desc, right_id) as n from m)
    select left_id, right_id, score, n, case when score >= 0.85 then 'strong' when score >= 0.65 then 'medium' else 'weak' end as strength from b where n <= 3""")
def candidates(spark, root):
    """JON-03: the three best candidates of receipts, with their strength; as its SQL, only rows with a date written yyyy-MM-dd."""
    return _candidates(*_sides(spark, root))


@query("jon_03_candidates_all")
def candidates_all(spark, root):
    """JON-03: the same for receipts and transactions whatever the writing of their dates (no SQL)."""
    return _candidates(*_all_sides(spark, root))


def _candidates(r, t):
    near = r.select(F.col("id").alias("left_id"), F.col("day").alias("ld"), F.col("amount").alias("la")).withColumn("day", F.explode(F.sequence(F.date_sub("ld", 2), F.date_add("ld", 2))))
    step = F.floor(F.col("la") / 10)
    near = near.withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
    m = near.join(t.select(F.col("id").alias("right_id"), "day", "amount", F.floor(F.col("amount") / 10).alias("step")), ["day", "step"]).where("abs(la - amount) < 10")
    score = F.round(0.5 * (1 - F.abs(F.datediff("ld", "day")) / 3.0) + 0.5 * (1 - F.abs(F.col("la") - F.col("amount")) / 10.0), 6)
    m = evaluate.ranked(m.withColumn("score", score), ["left_id"], [F.desc("score"), F.col("right_id")], "n").where("n <= 3")
    return m.select("left_id", "right_id", "score", "n", F.when(F.col("score") >= 0.85, "strong").when(F.col("score") >= 0.65, "medium").otherwise("weak").alias("strength"))


@query("jon_05_not_in", "select id from canonical_records where source = 'bank' and id not in (select matched_transaction_id from canonical_records where matched_transaction_id is not null)")
def not_matched(spark, root):
    """JON-05: bank rows that no receipt is matched to (null-aware anti join)."""
    c = table(spark, root, "canonical_records")
    return joins.not_in(c.where("source = 'bank'").select("id"), "id", c.where("matched_transaction_id is not null"), "matched_transaction_id")


@query("jon_05_null_rules", """
    select 'nulls' as case_, count(*) as n from canonical_records where merchant_norm not in (select merchant_norm from gold_transactions)
    union all select 'no nulls', count(*) from canonical_records where merchant_norm not in (select merchant_norm from gold_transactions where merchant_norm is not null)
    union all select 'empty', count(*) from canonical_records where merchant_norm not in (select merchant_norm from gold_transactions where false)""")
def null_rules(spark, root):
    """JON-05: NOT IN with nulls on both sides, on the left only, and with nothing on the right."""
    c, g = table(spark, root, "canonical_records").select("merchant_norm"), table(spark, root, "gold_transactions").select("merchant_norm")
    out = None
    for name, others in (("nulls", g), ("no nulls", g.where("merchant_norm is not null")), ("empty", g.where("false"))):
        one = joins.not_in(c, "merchant_norm", others, "merchant_norm").agg(F.count("*").alias("n")).select(F.lit(name).alias("case_"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("jon_08_anti", "select rowid from staging_transactions s where not exists (select 1 from canonical_records c where c.merchant_raw = s.merchant_raw)")
def anti(spark, root):
    """JON-08..09: staging rows whose merchant the store doesn't have; null keys are kept."""
    known = table(spark, root, "canonical_records").select("merchant_raw").where("merchant_raw is not null").distinct()
    return table(spark, root, "staging_transactions").join(known, "merchant_raw", "left_anti").select("rowid")


@query("jon_10_queues", """
    with m as (select distinct matched_transaction_id as mid from canonical_records where matched_transaction_id is not null)
    select id, case when category_pred <> category_final then 'conflict' when source = 'receipt' and matched_transaction_id is null then 'unmatched_receipt'
      when source = 'bank' and mid is null then 'unmatched_bank' when confidence < 0.7 then 'low_confidence' end as issue
    from canonical_records left join m on id = mid where category_pred <> category_final or (source = 'receipt' and matched_transaction_id is null) or (source = 'bank' and mid is null) or confidence < 0.7""")
def queues(spark, root):
    """JON-10: rows in any of four queues, with the first by priority."""
    c = table(spark, root, "canonical_records")
    m = c.where("matched_transaction_id is not null").select(F.col("matched_transaction_id").alias("mid")).distinct()
    issue = F.when(F.col("category_pred") != F.col("category_final"), "conflict").when((F.col("source") == "receipt") & F.col("matched_transaction_id").isNull(), "unmatched_receipt")
    issue = issue.when((F.col("source") == "bank") & F.col("mid").isNull(), "unmatched_bank").when(F.col("confidence") < 0.7, "low_confidence")
    return c.join(m, c["id"] == m["mid"], "left").select("id", issue.alias("issue")).where("issue is not null")


@query("jon_11_replay", "select s.split, count(*) as n, sum(cast(g.amount as decimal(18,2))) as amount from gold_transactions g join gold_splits s using (id) group by 1")
def replay(spark, root):
    """JON-11: a persisted split applied by id, summed."""
    g = table(spark, root, "gold_transactions").join(table(spark, root, "gold_splits"), "id")
    return g.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"))


@query("agg_01_totals", f"select {_EFFECTIVE} as category, sum(cast(amount as decimal(18,2))) as amount, count(*) as n from canonical_records where direction = 'expense' and amount is not null group by 1")
def totals(spark, root):
    """AGG-01: expenses per effective category."""
    c = table(spark, root, "canonical_records").where("direction = 'expense' and amount is not null")
    return c.groupBy(_effective().alias("category")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"), F.count("*").alias("n"))


@query("agg_02_metrics", """
    select count(*) as total_records, count_if(source = 'receipt') as total_receipts, count_if(source = 'receipt' and matched_transaction_id is not null) as matched_receipts,
      count_if(confidence < 0.7 and category_final is null) as needs_review, round(avg(confidence), 6) as avg_confidence,
      round(case when count_if(source = 'receipt') = 0 then 0 else count_if(source = 'receipt' and matched_transaction_id is not null) / count_if(source = 'receipt') end, 6) as match_rate from canonical_records""")
def metrics(spark, root):
    """AGG-02..03: all counters in one pass."""
    r = F.col("source") == "receipt"
    got = r & F.col("matched_transaction_id").isNotNull()
    rate = F.when(F.count_if(r) == 0, 0.0).otherwise(F.count_if(got) / F.count_if(r))
    return table(spark, root, "canonical_records").agg(F.count("*").alias("total_records"), F.count_if(r).alias("total_receipts"), F.count_if(got).alias("matched_receipts"), F.count_if((F.col("confidence") < 0.7) & F.col("category_final").isNull()).alias("needs_review"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.round(rate, 6).alias("match_rate"))


@query("agg_04_ambiguous", "select coalesce(merchant_norm, merchant_raw, '') as merchant, count(*) as n, round(avg(coalesce(confidence, 0)), 6) as confidence from canonical_records group by 1 having count(*) >= 2 order by 3, 2 desc, 1 limit 10")
def ambiguous(spark, root):
    """AGG-04: the ten merchants of least confidence (a top-k report)."""
    c = table(spark, root, "canonical_records").groupBy(F.coalesce("merchant_norm", "merchant_raw", F.lit("")).alias("merchant"))
    c = c.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("confidence")).where("n >= 2")
    return c.orderBy("confidence", F.desc("n"), "merchant").limit(10)


@query("agg_05_value_counts", "select nullif(trim(mcc_description), '') as value, count(*) as n, count(distinct merchant_raw) as merchants from staging_transactions group by 1")
def value_counts(spark, root):
    """AGG-05, AGG-19: values of a trimmed column with counts and distinct counts."""
    t = table(spark, root, "staging_transactions")
    return t.groupBy(F.nullif(F.trim("mcc_description"), F.lit("")).alias("value")).agg(F.count("*").alias("n"), F.countDistinct("merchant_raw").alias("merchants"))


_WEAK = ["COGS", "Insurance", "Taxes & Licenses", "Rent & Utilities", "Education & Training"]


@query("agg_06_coverage", "select c.category, count(g.id) as n, case when count(g.id) >= 100 then 'OK' else 'UNDER' end as status from (values " + ", ".join(f"('{w}')" for w in _WEAK) + ") c(category) left join gold_transactions g on g.category_final = c.category group by 1")
def coverage(spark, root):
    """AGG-06: counts of listed categories against a target, zeros too."""
    listed = spark.createDataFrame([(w,) for w in _WEAK], "category string")
    g = table(spark, root, "gold_transactions").groupBy(F.col("category_final").alias("category")).agg(F.count("*").alias("n"))
    return listed.join(g, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n")).withColumn("status", F.when(F.col("n") >= 100, "OK").otherwise("UNDER"))


@query("agg_07_balance", "select coalesce(category_final, '<missing>') as category, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as pct from gold_transactions group by 1")
def balance(spark, root):
    """AGG-07: label balance in percent."""
    g = table(spark, root, "gold_transactions").groupBy(F.coalesce("category_final", F.lit("<missing>")).alias("category")).agg(F.count("*").alias("n"))
    total = table(spark, root, "gold_transactions").count()
    return g.select("category", "n", F.round(100.0 * F.col("n") / F.lit(total), 4).alias("pct"))


@query("agg_08_stats", "select source, count(*) as n, count_if(amount is null) as missing, count_if(amount < 0) as negative, count_if(amount = 0) as zero, count_if(amount > 0) as positive, min(amount) as least, max(amount) as most from gold_transactions group by 1")
def stats(spark, root):
    """AGG-08: counters of amounts per source."""
    a = F.col("amount")
    return table(spark, root, "gold_transactions").groupBy("source").agg(F.count("*").alias("n"), F.count_if(a.isNull()).alias("missing"), F.count_if(a < 0).alias("negative"), F.count_if(a == 0).alias("zero"), F.count_if(a > 0).alias("positive"), F.min(a).alias("least"), F.max(a).alias("most"))


@query("agg_09_disagreement", """
    with d as (select coalesce(category_pred, '<blank>') as p, source as s, coalesce(direction, '<blank>') as x, coalesce(category_pred <> category_final, false) as hit from canonical_records)
    select case when grouping(p) = 0 then 'category_pred' when grouping(s) = 0 then 'source' else 'direction' end as dimension, coalesce(p, s, x) as value, count(*) as n, count_if(hit) as n_hit
    from d group by grouping sets ((p), (s), (x))""")
def disagreement(spark, root):
    """AGG-09..10: disagreement of two labels along several dimensions in one pass."""
    hit = F.coalesce(F.col("category_pred") != F.col("category_final"), F.lit(False))
    return evaluate.sliced(table(spark, root, "canonical_records"), ["category_pred", "source", "direction"], hit)


def _labelled(spark, root):
    return table(spark, root, "gold_transactions").where("category_pred is not null and category_final is not null")


_CONF = "select category_final as truth, category_pred as predicted, count(*) as n from gold_transactions where category_pred is not null and category_final is not null group by 1, 2"
_PER = f"""with c as ({_CONF}), t as (select truth as label, sum(n) as support, sum(case when truth = predicted then n else 0 end) as tp from c group by 1), p as (select predicted as label, sum(n) as predicted from c group by 1),
    j as (select coalesce(t.label, p.label) as label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted, coalesce(tp, 0) as tp from t full join p on t.label = p.label),
    q as (select *, case when predicted > 0 then tp / predicted else 0 end as pr, case when support > 0 then tp / support else 0 end as rc from j),
    f as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1 from q)"""


@query("agg_11_per_class", f"{_PER} select label, cast(support as bigint) as support, cast(predicted as bigint) as predicted, cast(tp as bigint) as tp, round(pr, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1 from f")
def per_class(spark, root):
    """AGG-11: support, precision, recall and F1 of every label."""
    c = evaluate.per_class(_labelled(spark, root), "category_final", "category_pred")
    return c.select("label", "support", "predicted", "tp", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("agg_12_summary", f"{_PER} select round(sum(tp) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, cast(sum(support) as bigint) as n from f")
def metrics_of_labels(spark, root):
    """AGG-12: accuracy, macro and weighted F1."""
    s = evaluate.summary(_labelled(spark, root), "category_final", "category_pred")
    return s.select(*[F.round(x, 6).alias(x) for x in ("accuracy", "macro_f1", "weighted_f1")], "n")


@query("agg_13_confusion", f"with c as ({_CONF}) select truth, predicted, n, round(n / sum(n) over (partition by truth), 6) as row_share from c")
def confusion(spark, root):
    """AGG-13: confusion counts with the share of their row."""
    c = evaluate.confusion(_labelled(spark, root), "category_final", "category_pred")
    return c.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6))


@query("agg_14_top_confusions", f"with c as ({_CONF}) select * from c where truth <> predicted order by n desc, truth, predicted limit 10")
def top_confusions(spark, root):
    """AGG-14: the ten most frequent confusions (a top-k report)."""
    return evaluate.top_confusions(_labelled(spark, root), "category_final", "category_pred", 10)


@query("agg_22_delta", """
    with a as (select category_final as truth, category_pred as predicted, count(*) as n from gold_transactions where ingest_batch <= 20 and category_final <> category_pred group by 1, 2),
    b as (select category_final as truth, category_pred as predicted, count(*) as n from gold_transactions where ingest_batch > 20 and category_final <> category_pred group by 1, 2)
    select coalesce(a.truth, b.truth) as truth, coalesce(a.predicted, b.predicted) as predicted, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.truth = b.truth and a.predicted = b.predicted""")
def delta(spark, root):
    """AGG-22: change of confusions between two halves (full outer join)."""
    w = table(spark, root, "gold_transactions").where("category_final <> category_pred")
    c = w.groupBy(F.col("category_final").alias("truth"), F.col("category_pred").alias("predicted")).agg((F.count_if(F.col("ingest_batch") > 20) - F.count_if(F.col("ingest_batch") <= 20)).alias("delta"), F.count("ingest_batch").alias("k"))
    return c.where("k > 0").drop("k")


@query("agg_24_folds", """
    with f as (select id, category_final, (row_number() over (partition by category_final order by md5('7|' || id), id) - 1) % 5 as fold, amount from gold_transactions where category_final is not null)
    select fold, count(*) as n, round(avg(amount), 4) as mean, round(stddev_pop(amount), 4) as deviation, min(amount) as least, max(amount) as most from f group by 1""")
def fold_summary(spark, root):
    """TOP-16, AGG-24: stratified folds and their summary."""
    f = sampling.folds(table(spark, root, "gold_transactions").where("category_final is not null"), "id", "category_final", 5, 7)
    return f.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean"), F.round(F.stddev_pop("amount"), 4).alias("deviation"), F.min("amount").alias("least"), F.max("amount").alias("most"))


@query("agg_26_dominant", "select merchant_norm, count(*) as n, count(distinct source) as sources from gold_transactions where merchant_norm is not null group by 1 having count(*) >= 3")
def dominant(spark, root):
    """AGG-26: merchants with at least three rows."""
    return table(spark, root, "gold_transactions").where("merchant_norm is not null").groupBy("merchant_norm").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).where("n >= 3")


@query("top_02_per_group", "select rowid, source from (select rowid, source, row_number() over (partition by source order by rowid) as n from staging_transactions where mcc is not null) where n <= 25")
def per_group(spark, root):
    """TOP-02: the first 25 rows of each group (a batch sampler)."""
    t = table(spark, root, "staging_transactions").where("mcc is not null")
    return sampling.per_group(t, "source", [F.col("rowid")], 25).select("rowid", "source")


@query("top_03_hardest", "select rowid, (case when mcc is null then 1.5 else 0 end + case when description is null then 1.2 else 0 end + case when category_external is null then 2.0 else 0 end)::double as score from staging_transactions order by score desc, rowid limit 200")
def hardest(spark, root):
    """TOP-03: the 200 hardest rows by a score (a batch sampler)."""
    missing = lambda c, w: F.when(F.col(c).isNull(), w).otherwise(0.0)
    t = table(spark, root, "staging_transactions").select("rowid", (missing("mcc", 1.5) + missing("description", 1.2) + missing("category_external", 2.0)).alias("score"))
    return t.orderBy(F.desc("score"), "rowid").limit(200)


@query("top_04_round_robin", """
    with s as (select rowid, mcc, row_number() over (partition by mcc order by rowid) as turn, count(*) over (partition by mcc) as size from staging_transactions)
    select rowid, mcc from s order by turn, size, mcc nulls first, rowid limit 300""")
def round_robin(spark, root):
    """TOP-04: 300 rows in turns over the codes, rarest first (a batch sampler)."""
    return sampling.round_robin(table(spark, root, "staging_transactions").select("rowid", "mcc"), "mcc", "rowid", 300)


@query("top_05_keep_first", "select rowid from (select rowid, row_number() over (partition by lower(coalesce(merchant_raw, '')), lower(coalesce(description, '')), coalesce(cast(cast(amount as decimal(18,2)) as varchar), '') order by rowid) as n from staging_transactions) where n = 1")
def keep_first(spark, root):
    """TOP-05: first row of each fingerprint."""
    t = table(spark, root, "staging_transactions")
    t = t.select("rowid", F.lower(F.coalesce("merchant_raw", F.lit(""))).alias("m"), F.lower(F.coalesce("description", F.lit(""))).alias("d"), F.coalesce(F.col("amount").cast("decimal(18,2)").cast("string"), F.lit("")).alias("a"))
    return t.groupBy("m", "d", "a").agg(F.min("rowid").alias("rowid")).select("rowid")


@query("top_13_sample", "select id from gold_transactions order by md5('3|' || id), id limit 100")
def seeded_sample(spark, root):
    """TOP-13: a seeded sample of 100 rows."""
    return sampling.sample(table(spark, root, "gold_transactions").select("id"), "id", 100, 3)


@query("top_14_split", """
    with p as (select id, category_final, (row_number() over (partition by category_final order by md5('5|' || id), id) - 0.5) / count(*) over (partition by category_final) as p from gold_transactions)
    select id, case when p < 0.7 then 'train' when p < 0.85 then 'validation' else 'test' end as split from p""")
def stratified(spark, root):
    """TOP-14..15, SNK-20: stratified split."""
    g = table(spark, root, "gold_transactions").select("id", "category_final")
    return sampling.stratified_split(g, "id", "category_final", {"train": 0.7, "validation": 0.15, "test": 0.15}, 5).select("id", "split")


@query("set_01_intersect", "select merchant_raw from canonical_records where merchant_raw is not null intersect select merchant_raw from gold_transactions where merchant_raw is not null")
def intersect(spark, root):
    """SET-01."""
    a, b = (table(spark, root, t).select("merchant_raw").where("merchant_raw is not null") for t in ("canonical_records", "gold_transactions"))
    return a.intersect(b)


@query("set_02_union", "select category_pred as label from gold_transactions union select category_final from gold_transactions")
def union(spark, root):
    """SET-02, SET-04."""
    g = table(spark, root, "gold_transactions")
    return g.select(F.col("category_pred").alias("label")).union(g.select("category_final")).distinct()


@query("set_03_difference", "select merchant_raw from gold_transactions except select merchant_raw from canonical_records")
def difference(spark, root):
    """SET-03."""
    return table(spark, root, "gold_transactions").select("merchant_raw").subtract(table(spark, root, "canonical_records").select("merchant_raw"))


@query("src_09_union_feeds", """
    select 'bank' as feed, record_id, "Description" as text, "Amount" as amount from bank_bofa union all select 'quickbooks', record_id, "Description", "Amount" from quickbooks_sample
    union all select 'toast', record_id, item_id, total from toast_sample""")
def union_feeds(spark, root):
    """SRC-09: feeds of different columns in one frame."""
    b = table(spark, root, "bank_bofa").select(F.lit("bank").alias("feed"), "record_id", F.col("Description").alias("text"), F.col("Amount").alias("amount"))
    q = table(spark, root, "quickbooks_sample").select(F.lit("quickbooks").alias("feed"), "record_id", F.col("Description").alias("text"), F.col("Amount").alias("amount"))
    t = table(spark, root, "toast_sample").select(F.lit("toast").alias("feed"), "record_id", F.col("item_id").alias("text"), F.col("total").alias("amount"))
    return b.unionByName(q).unionByName(t)


@query("rel_01_revenue", """
    select n.n_name as nation, year(o.o_orderdate) as y, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) as revenue, count(*) as n
    from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by 1, 2""")
def revenue(spark, root):
    """Relational check: four joins and an aggregation on the star schema."""
    li, o, c, n = (table(spark, root, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
