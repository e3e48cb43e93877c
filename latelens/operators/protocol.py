"""Matrices, candidate selection, caps, digests and ledgers' checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """All combinations of short literal axes."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def grid_difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Combinations that are missing or weren't asked for."""
    cols = expected.columns
    a = expected.exceptAll(got.select(*cols)).withColumn("difference", F.lit("missing"))
    return a.unionByName(got.select(*cols).exceptAll(expected).withColumn("difference", F.lit("unexpected")))


def matrix(spark: SparkSession, stages: list[tuple[str, int, int]]) -> DataFrame:
    """(stage, runs, credits): the planned runs and all their credits."""
    return spark.createDataFrame(stages, "stage string, runs int, credits_per_run int").withColumn("credits", F.col("runs") * F.col("credits_per_run"))


def select_candidate(candidates: DataFrame, group: str = "stage", tie: float = 1e-6) -> DataFrame:
    """Per group the candidate of least loss; within the tie less compute, fewer parameters, lower digest.

    A group with an infrastructure failure is blocked and gives no row."""
    w = Window.partitionBy(group)
    d = candidates.withColumn("blocked", F.max(F.col("status") == "infra_failure").over(w)).withColumn("least", F.min(F.when(F.col("status") == "ok", F.col("loss"))).over(w))
    d = d.where(~F.col("blocked") & (F.col("status") == "ok") & (F.col("loss") <= F.col("least") + tie))
    first = Window.partitionBy(group).orderBy("compute_seconds", "parameters", "digest")
    return d.withColumn("i", F.row_number().over(first)).where("i = 1").drop("i", "blocked", "least")


def cap_projection(options: DataFrame, per_step_seconds: float, fixed_seconds: float, credits: int, cap_seconds: float, multiplier: float = 1.5) -> DataFrame:
    """Projected seconds for each number of steps per credit, and whether the cap holds."""
    d = options.withColumn("projected", (F.col("steps_per_credit") * credits * per_step_seconds + fixed_seconds) * multiplier)
    return d.withColumn("fits", F.col("projected") <= cap_seconds)


def largest_fitting(projection: DataFrame) -> DataFrame:
    return projection.agg(F.max(F.when(F.col("fits"), F.col("steps_per_credit"))).alias("steps_per_credit"))


def exposure_violations(exposures: DataFrame, batch: int) -> DataFrame:
    """Steps of a credit that didn't see a whole batch."""
    return exposures.groupBy("credit_id", "step").agg(F.count("*").alias("n")).where(F.col("n") != batch)


def budget(exposures: DataFrame, steps: int, batch: int) -> DataFrame:
    """Per credit: steps, examples, and whether they are the planned ones."""
    g = exposures.groupBy("credit_id").agg(F.count_distinct("step").alias("steps"), F.count("*").alias("examples"))
    return g.withColumn("complete", (F.col("steps") == steps) & (F.col("examples") == F.lit(steps * batch)))


def ordered_digest(df: DataFrame, order: list[str], value: str, block: int = 10_000) -> DataFrame:
    """A digest of a column in order: digests of blocks of rows, and of blocks of these, until one is left.

    Rows are ranked by ranges; no cell holds more than a block. Of no rows it is the digest of nothing."""
    from .sampling import ranked

    d = ranked(df.select(*order, F.col(value).cast("string").alias("h")), order).select("rank", "h")
    left, folds = max(1, df.count()), 0
    while left > 1 or folds < 2:
        x = F.sort_array(F.collect_list(F.struct("rank", F.coalesce("h", F.lit("")).alias("h"))))
        d = d.groupBy(F.floor(F.col("rank") / block).alias("b")).agg(x.alias("x"))
        d = d.select(F.col("b").alias("rank"), F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("h"))
        left, folds = -(-left // block), folds + 1
    return d.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("digest"))


def compute_fields(runs: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def period_rows(clicks: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    from .features import period_of

    return clicks.groupBy(period_of(F.col("click_day"), bounds).alias("period")).agg(F.count("*").alias("n"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
