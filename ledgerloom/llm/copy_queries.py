"""Queries on duplicates hidden by formatting (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import copies
from ledgerloom.runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Every copy beyond the first with the least id of its record."""
    return copies.copy_pairs(table(spark, root, "gold_transactions"))


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    """One row per record with its number of copies."""
    return copies.collapse(table(spark, root, "gold_transactions"))


_KEY = r"""
    select id, source, transaction_date,
           array_to_string(list_sort(list_filter(regexp_split_to_array(lower(coalesce(merchant_raw, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')), ' ') as words,
           cast(round(amount * 100) as bigint) as cents,
           nullif(lower(trim(direction, e' \t\r\n' || chr(160))), '') as direction
    from gold_transactions
"""

QUERIES = {"p3_found": p3_found, "p3_records": p3_records}
ORACLES = {
    "p3_found": f"""
        with k as ({_KEY}),
        m as (select *, min(id) over (partition by source, transaction_date, words, cents, direction) as id_a from k where cents is not null and direction is not null)
        select id_a, id as id_b from m where id <> id_a""",
    "p3_records": f"""
        with k as ({_KEY})
        select min(id) as id, source, transaction_date, words, cents, direction, count(*) as n_copies
        from k group by source, transaction_date, words, cents, direction, case when cents is null or direction is null then id end""",
}
