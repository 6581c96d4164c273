"""Text classifiers, similarity and active-learning selection on Spark's own ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_classifier(df: DataFrame, text: str, label: str, features: int = 5000, iterations: int = 50) -> PipelineModel:
    """TF-IDF of words and word pairs with class-balanced logistic regression.

    Null labels and empty texts are left out; the weight of a class is
    n / (classes * n_class). Adds predicted_label and probability on transform.
    """
    rows = df.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0))
    per = rows.groupBy(label).agg(F.count("*").alias("_n"))
    mean = per.agg(F.avg("_n")).first()[0]
    rows = rows.join(per, label).withColumn("_weight", F.lit(mean) / F.col("_n"))
    labels = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\b\w\w+\b", gaps=False), StopWordsRemover(inputCol="_w", outputCol="_s"), NGram(inputCol="_s", outputCol="_b", n=2),
        CountVectorizer(inputCol="_s", outputCol="_c1", minDF=2, vocabSize=features), CountVectorizer(inputCol="_b", outputCol="_c2", minDF=2, vocabSize=features),
        VectorAssembler(inputCols=["_c1", "_c2"], outputCol="_c"), IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_weight", maxIter=iterations, regParam=0.001),
        IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(labels.transform(rows))


def predictions(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, predicted_label, confidence (the greatest probability)."""
    return model.transform(df).select(*keep, "predicted_label", F.array_max(vector_to_array("probability")).alias("confidence"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, v: s + v)
    return F.transform(exps, lambda x: x / total)


def uncertainty(p: Column, kind: str) -> Column:
    """Score of a probability array, higher is less certain: ``least``, ``margin`` or ``entropy``."""
    if kind == "least":
        return 1 - F.array_max(p)
    if kind == "margin":
        ordered = F.sort_array(p, asc=False)
        return 1 - (ordered[0] - ordered[1])
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - v * F.log(v + 1e-10))


def diverse(df: DataFrame, key: str, vector: str, score: Column, k: int, per_cluster: int, seed: int = 42) -> DataFrame:
    """The least certain rows of each of k clusters."""
    points = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed, maxIter=10).fit(points)
    w = Window.partitionBy("cluster").orderBy(F.desc("_score"), key)
    placed = model.transform(points).withColumn("_score", score).withColumn("_n", F.row_number().over(w))
    return placed.where(F.col("_n") <= per_cluster).select(key, "cluster", F.col("_score").alias("score"))
