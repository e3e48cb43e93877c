"""Learners: a one-feature logistic trained by gradient sums, and reference models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelens.functions.numeric import bce_with_logits, sigmoid


def predict(feature: Column, weight: float, bias: float) -> Column:
    return sigmoid(F.lit(weight) * feature + F.lit(bias))


def gradient_step(records: DataFrame, weight: float, bias: float, rate: float) -> tuple[float, float]:
    """One full-batch step: three sums over the records(feature, target, weight)."""
    r = (predict(F.col("feature"), weight, bias) - F.col("target")) * F.col("weight")
    gw, gb, n = records.agg(F.sum(r * F.col("feature")), F.sum(r), F.sum("weight")).first()
    return (weight, bias) if not n else (weight - rate * gw / n, bias - rate * gb / n)


def spend_credit(records: DataFrame, weight: float, bias: float, steps: int, rate: float) -> tuple[float, float]:
    """steps gradient steps over the legal records; the loop is over steps."""
    records = records.cache()
    try:
        for _ in range(steps):
            weight, bias = gradient_step(records, weight, bias, rate)
        return weight, bias
    finally:
        records.unpersist()


def weighted_bce(df: DataFrame, z: Column, y: Column, w: Column) -> DataFrame:
    return df.agg((F.sum(w * bce_with_logits(y, z)) / F.sum(w)).alias("loss"))


def logistic_reference(train: DataFrame, features: list[str], label: str = "final_label"):
    """Standardised logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol=label, regParam=0.0, maxIter=100)]
    return Pipeline(stages=stages).fit(train)


def boosted_reference(train: DataFrame, features: list[str], label: str = "final_label", trees: int = 100, rate: float = 0.05, depth: int = 5):
    """Gradient-boosted trees, of as many leaves as depth allows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="x"), GBTClassifier(featuresCol="x", labelCol=label, maxIter=trees, stepSize=rate, maxDepth=depth, seed=17)]
    return Pipeline(stages=stages).fit(train)


def scored(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("probability", vector_to_array("probability")[1])


def score_snapshots(df: DataFrame, snapshots: list[tuple[float, float, float]]) -> DataFrame:
    """Predictions of (fraction, weight, bias) snapshots, all in one pass."""
    s = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), predict(F.col("feature"), w, b).alias("probability")) for f, w, b in snapshots]))
    return df.select("*", s.alias("s")).select("*", "s.fraction", "s.probability").drop("s")
