"""Integrity of stores as one-pass counts of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _counted(df: DataFrame, rules: dict) -> DataFrame:
    return df.agg(*[F.count_if(F.coalesce(r, F.lit(True))).alias(k) for k, r in rules.items()])


def truth_part(truth: DataFrame, features: DataFrame, label: int, maturity: float, tolerance: float = 1e-9) -> DataFrame:
    """One row of counts for a truth table of one label: wrong labels, clicks without features, unequal
    times, and delays outside the window or, for negatives, not exactly the window."""
    j = truth.join(features.select("click_id", F.col("click_time").alias("__t")), "click_id", "left")
    delay = F.col("available_at") - F.col("click_time")
    wrong = (delay < -tolerance) | (delay > maturity + tolerance) if label else F.abs(delay - maturity) > tolerance
    return _counted(j, {"wrong_label": F.col("final_label") != label, "unknown_click": F.col("__t").isNull(), "unequal_time": F.coalesce(F.col("__t") != F.col("click_time"), F.lit(False)), "wrong_delay": wrong})


def feature_store(df: DataFrame, buckets: dict[str, int], first_day: int, last_day: int) -> DataFrame:
    """One row of counts for a feature table: cold flags, buckets, non-finite values and days."""
    rules = {
        "cold_user": F.col("cold_user") != (F.col("prior_user_clicks") == 0),
        "cold_product": F.col("cold_product") != (F.col("prior_product_clicks") == 0),
        "day_out_of_range": ~F.col("click_day").between(first_day, last_day),
        "time_not_finite": F.isnan(F.col("click_time").cast("double")) | (F.abs(F.col("click_time").cast("double")) == float("inf")),
    }
    for f, n in buckets.items():
        rules[f"{f}_bucket"] = ~F.col(f"{f}_bucket").between(0, n - 1)
    return _counted(df, rules)


def missing_days(df: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Days of the range without rows."""
    every = df.sparkSession.range(first_day, last_day + 1).select(F.col("id").cast("int").alias("click_day"))
    return every.join(df.select("click_day").distinct(), "click_day", "left_anti")


def ledger(records: DataFrame, now) -> DataFrame:
    """One row of counts for an availability ledger: records of the future and repeated ones."""
    g = records.groupBy("click_id", "kind").agg(F.count("*").alias("n"), F.max("available_at").alias("at"))
    return g.agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("repeated"), F.count_if(F.col("at") > now).alias("future"))


def excluded_members(exposures: DataFrame, members: DataFrame) -> DataFrame:
    """Exposures of clicks that must never train."""
    return exposures.join(members.select("click_id"), "click_id", "left_semi")


def not_increasing(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value isn't above the one before under the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("before", before).where(F.col(value) <= F.col("before"))


def late_rows(events: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Events at or after now, and the late ones, which a run must not take."""
    return events.where(F.col("time") >= now), events.where(F.col("time") < now)
