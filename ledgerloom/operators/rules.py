"""Ordered first-match rules: the order of the list is the priority, tokens match as substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str, float]


def first_match(text: Column, rules: list[Rule]) -> Column:
    """struct(token, label, confidence) of the first rule whose token the upper-cased text contains, else null."""
    table = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(c).alias("label"), F.lit(p).alias("confidence")) for t, c, p in rules])
    upper = F.upper(F.coalesce(text, F.lit("")))
    return F.get(F.filter(table, lambda r: F.contains(upper, r["token"])), F.lit(0))


def all_matches(text: Column, tokens: list[str]) -> Column:
    """Every token that the text contains, in the order of the list."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(upper, t))


def cascade(*steps: Column) -> Column:
    """The first step that gives a match: steps are structs of one shape, null where they don't apply."""
    return F.coalesce(*steps)


def mapped(key: Column, table: dict[str, str]) -> Column:
    """Value of a small mapping by trimmed key; unknown and null keys give null."""
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return literal[F.trim(key)]


def routed(rule: Column, rule_confidence: Column, model: Column, threshold: float) -> Column:
    """The rule's label from the threshold on, below it the model's if there is one."""
    return F.when(rule_confidence >= threshold, rule).otherwise(F.coalesce(model, rule))
