"""Similarity, active learning, classifiers and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import generate, learning
from ledgerloom.runtime import table


def _probabilities(spark, root):
    e = table(spark, root, "embeddings")
    return e.select("vec_id", "embedding", "label", learning.softmax(F.slice("embedding", 1, 5)).alias("p"))


def uncertain(kind: str):
    def query(spark, root):
        p = _probabilities(spark, root).select("vec_id", F.round(learning.uncertainty(F.col("p"), kind), 6).alias("score"))
        return p.orderBy(F.desc("score"), "vec_id").limit(50)

    query.__doc__ = f"MLX-10: the 50 rows of least certainty by {kind} (a selection for labelling)."
    return query


def cosine_to_first(spark, root):
    """MLX-13: cosine of every vector to that of the least id."""
    e = table(spark, root, "embeddings")
    first = e.orderBy("vec_id").first()
    other = F.array(*[F.lit(float(x)) for x in first["embedding"]])
    return e.select("vec_id", F.round(learning.cosine(F.col("embedding"), other), 5).alias("cosine"))


def diverse(spark, root):
    """MLX-11: the least certain rows of ten clusters."""
    p = _probabilities(spark, root)
    return learning.diverse(p, "vec_id", "embedding", learning.uncertainty(F.col("p"), "entropy"), 10, 5)


def classifier(spark, root):
    """MLX-01, MLX-05: labels predicted for every gold row by a classifier trained on the train split."""
    g = table(spark, root, "gold_transactions").select("id", "category_final", F.concat_ws(" ", "merchant_raw", F.get_json_object("raw_payload", "$.description"), F.get_json_object("raw_payload", "$.mcc_description")).alias("text"))
    train = g.join(table(spark, root, "gold_splits").where("split = 'train'").select("id"), "id")
    return learning.predictions(learning.text_classifier(train, "text", "category_final"), g, ["id", "category_final"])


def noisy_names(spark, root):
    """STR-15: up to three noisy variants of every merchant."""
    return generate.variants(table(spark, root, "gold_transactions"), "merchant_norm", 3)


def pairs(spark, root):
    """GEN-01: a linked bank row for every receipt."""
    r = table(spark, root, "gold_transactions").where("source = 'receipt' and amount > 0").withColumn("day", F.col("transaction_date").try_cast("date"))
    return generate.linked_pairs(r, "id", "day", "amount", "merchant_raw")


_P = """with e as (select vec_id, embedding[1:5] as s from embeddings), x as (select vec_id, list_transform(s, lambda v: exp(v::double - list_max(s)::double)) as e from e),
    p as (select vec_id, list_transform(e, lambda v: v / list_sum(e)) as p from x)"""
QUERIES = {
    "mlx_10_least": uncertain("least"), "mlx_10_margin": uncertain("margin"), "mlx_10_entropy": uncertain("entropy"), "mlx_13_cosine": cosine_to_first,
    "mlx_11_diverse": diverse, "mlx_01_classifier": classifier, "str_15_noisy_names": noisy_names, "gen_01_pairs": pairs,
}
ORACLES = {
    "mlx_10_least": f"{_P} select vec_id, round(1 - list_max(p), 6) as score from p order by score desc, vec_id limit 50",
    "mlx_10_margin": f"{_P} select vec_id, round(1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]), 6) as score from p order by score desc, vec_id limit 50",
    "mlx_10_entropy": f"{_P} select vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-10))), 6) as score from p order by score desc, vec_id limit 50",
    "mlx_13_cosine": "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings order by vec_id limit 1)::double[]), 5) as cosine from embeddings",
}
