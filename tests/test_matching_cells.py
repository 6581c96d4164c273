import datetime as dt
import random
from difflib import SequenceMatcher

from ledgerloom.operators import joins
from ledgerloom.operators.joins import best_match
from ledgerloom.plans import record_queries

FIELDS = "id string, day date, amount double, name string, rank string"
NAMES = ["acme tools", "acme tool", "acme", "tools acme", "acme tools and hardware supplies of the northern valley region limited", "acme tols and hardware supplies of the northern valley region limited", "", None, "zebra café", "zebra cafe", "zbera cafe", "stall", "stalls"]


def rows(seed, prefix, n):
    r, out = random.Random(seed), []
    for k in range(n):
        day = None if r.random() < 0.05 else dt.date(2024, 2, 20) + dt.timedelta(r.randrange(24))
        amount = r.choice([None, float("nan"), float("inf")]) if r.random() < 0.05 else round(r.uniform(60, 100), r.choice([0, 1, 2])) * r.choice([1, 1, 1, -1])
        out.append((f"{prefix}{k:04}", day, amount, r.choice(NAMES), f"{prefix}{k:04}"))
    return out


def brute(left, right, similarity):
    out = {}
    for i, day, amount, name, _ in left:
        best = (0.0, None)
        for j, d, a, other, _ in right if day and amount is not None else []:
            if d and a is not None and abs((day - d).days) < 3 and abs(amount - a) < 10:
                score = 0.3 * (1 - abs((day - d).days) / 3.0) + 0.5 * (1 - abs(amount - a) / 10.0) + 0.2 * similarity(name, other)
                if best[1] is None or score > best[0]:
                    best = (score, j)
        out[i] = (best[1] if best[0] >= 0.75 else None, best[0])
    return out


def floored(a, b):
    ratio = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    return ratio if ratio >= 0.7 else 0.0


def test_cells_give_the_best_of_all_pairs(spark):
    left, right = rows(1, "r", 400), rows(2, "b", 1500)
    a, b = spark.createDataFrame(left, FIELDS), spark.createDataFrame(right, FIELDS)
    got = lambda s: {r.left_id: (r.right_id, r.score) for r in best_match(a, b, s).collect()}
    assert got(joins.floored_ratio) == brute(left, right, floored)
    assert got(joins.equal_names) == brute(left, right, lambda x, y: float(x is not None and x == y))


def test_pairs_are_not_listed(spark):
    """Rows of one day and nearly one amount: every pair of them once passed the join."""
    day, n = dt.date(2024, 2, 20), 12000
    a = spark.range(n).selectExpr("concat('r', id) as id", f"date'{day}' as day", "20 + id % 100 / 100 as amount", "concat('payee ', id % 7) as name", "id as rank")
    b = spark.range(n).selectExpr("concat('b', id) as id", f"date'{day}' as day", "20 + id % 90 / 100 as amount", "concat('payee ', id % 11) as name", "id as rank")
    for similarity in (joins.equal_names, joins.floored_ratio):
        got = best_match(a.withColumn("amount", a.amount.cast("double")), b.withColumn("amount", b.amount.cast("double")), similarity)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.where("score >= 0.9").count() == n


def test_best_match_all_lists_no_pairs(spark):
    plan = record_queries.best_match_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Window" not in plan
