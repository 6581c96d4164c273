"""Mixing sources to target shares of tokens, counted by a public tokenizer."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.prefix import prefix_sums
from ledgerloom.runtime import written

TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's public encoder splits text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _counter(ranks_path: str):
    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        encoder = tiktoken.Encoding("ledgerloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_key": pdf["doc_key"], "source": pdf["source"], "tokens": sizes})

    return run


def token_counts(documents: DataFrame, key: str, source: str = "source", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, source, tokens) of every document; null and empty texts have none."""
    kind = documents.schema[key].dataType.simpleString()
    plain = documents.select(F.col(key).alias("doc_key"), F.col(source).alias("source"), "text")
    return plain.mapInPandas(_counter(f"{tokenizers}/{RANKS}"), f"doc_key {kind}, source string, tokens long").withColumnRenamed("doc_key", key)


def mixture(documents: DataFrame, key: str, targets: DataFrame, seed: int = 17, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(drawn documents, shares).

    ``targets`` has (source, target_share, max_repeats), one row a source. A
    source's budget is its share of the corpus's tokens (all documents, those
    of sources without target too). It is filled by whole passes over the
    source, at most ``max_repeats``, and a last partial pass: documents in the
    order of a seeded hash whose tokens still fit entirely into the rest. Drawn:
    (key, source, tokens, times). Shares: per target source the budget, what
    was drawn, and the share of the drawn total. A source with a null share or
    repeats draws nothing; a null source of documents has no target.
    """
    counted = written(token_counts(documents, key, tokenizers=tokenizers), "tokens")
    per_source = counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n_docs"))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    plan = targets.select("source", "target_share", "max_repeats").join(per_source, "source", "left")
    budget = F.floor(F.coalesce(F.col("target_share"), F.lit(0.0)) * F.lit(total))
    plan = plan.withColumn("budget", budget).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).withColumn("max_repeats", F.coalesce("max_repeats", F.lit(0)))
    passes = F.when(F.col("source_tokens") > 0, F.least(F.floor(F.col("budget") / F.col("source_tokens")), F.col("max_repeats"))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("int"))
    plan = written(plan.withColumn("rest", F.when(F.col("passes") < F.col("max_repeats"), F.col("budget") - F.col("passes") * F.col("source_tokens")).otherwise(0)), "plan")
    keyed = counted.where("source is not null").withColumn("draw", F.xxhash64(F.lit(seed), key))
    running = prefix_sums(keyed, "source", ["draw", key], "tokens")
    times = F.col("passes") + F.when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).otherwise(0)
    drawn = running.join(plan.select("source", "passes", "rest"), "source").select(key, "source", "tokens", times.alias("times")).where("times > 0")
    drawn = written(drawn, "drawn")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("drawn_tokens"), F.count("*").alias("drawn_docs"), F.max("times").alias("most_times"))
    whole = drawn.agg(F.sum(F.col("tokens") * F.col("times"))).first()[0]
    shares = plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "source_tokens", "budget",
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("drawn_docs", F.lit(0)).alias("drawn_docs"),
        F.coalesce("most_times", F.lit(0)).alias("most_times"), (F.coalesce("drawn_tokens", F.lit(0)) / F.lit(whole)).alias("actual_share"),
    )
    return drawn, shares
