"""Credit windows, fixed and drift-triggered spending, monitoring evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latelens.operators.states import replay_differences


def credit_windows(spark: SparkSession, start_day: int = 31, end_day: int = 90, window_days: int = 5) -> DataFrame:
    """Half-open tumbling windows with their early, midpoint and deadline days; the last may be short."""
    d = spark.range(start_day, end_day, window_days).select(F.col("id").cast("int").alias("start_day"))
    d = d.withColumn("end_day", F.least(F.col("start_day") + window_days, F.lit(end_day)))
    return d.select(
        ((F.col("start_day") - start_day) / window_days).cast("int").alias("window_id"), "start_day", "end_day", F.col("start_day").alias("early"),
        F.ceil((F.col("start_day") + F.col("end_day")) / 2).cast("int").alias("midpoint"), (F.col("end_day") - 1).alias("deadline"),
    )


def days_with_window(windows: DataFrame) -> DataFrame:
    """One row per day of each window."""
    return windows.select("*", F.explode(F.sequence("start_day", F.col("end_day") - 1)).alias("day"))


def fixed_spends(windows: DataFrame, policy: str) -> DataFrame:
    """Daily decisions of a fixed policy: early, midpoint or deadline."""
    d = days_with_window(windows)
    spend = F.col("day") == F.col(policy)
    reason = F.when(spend, F.lit(f"fixed_{policy}")).when(F.col("day") > F.col(policy), "already_spent").otherwise("waiting")
    return d.select("window_id", "day", spend.alias("spend"), reason.alias("reason"))


def evidence(examples: DataFrame, decision_days: DataFrame, lag_days: int = 31, cohort_days: int = 7, min_rows: int = 1000, min_variance: float = 25.0, bins: int = 10) -> DataFrame:
    """Per decision_day: rows, and the largest standardised residual over eligible bins with its bin.

    Days and bins are summed once; the sliding cohort is a join of daily sums, so rows aren't repeated
    for each decision that sees them."""
    b = F.least(F.floor(F.col("probability") * bins).cast("int"), F.lit(bins - 1))
    p, y = F.col("probability"), F.col("final_label")
    daily = examples.groupBy("click_day", b.alias("bin")).agg(F.count("*").alias("n"), F.sum(y - p).alias("r"), F.sum(p * (1 - p)).alias("v"))
    first, last = F.col("decision_day") - lag_days - cohort_days + 1, F.col("decision_day") - lag_days
    j = daily.join(F.broadcast(decision_days), F.col("click_day").between(first, last))
    g = j.groupBy("decision_day", "bin").agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum("v").alias("v"))
    ok = (F.col("n") >= min_rows) & (F.col("v") >= min_variance)
    g = g.withColumn("residual", F.when(ok, F.abs("r") / F.sqrt(F.col("v") + 1e-8)))
    best = F.max(F.when(ok, F.struct(F.col("residual").alias("score"), (-F.col("bin")).alias("b"))))
    g = g.groupBy("decision_day").agg(F.sum("n").alias("n"), best.alias("x"))
    d = decision_days.join(g, "decision_day", "left")
    return d.select("decision_day", F.coalesce("n", F.lit(0)).alias("n"), F.col("x.score").alias("score"), (-F.col("x.b")).alias("bin"))


def drift_decisions(windows: DataFrame, scores: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Daily decisions: spend at the first score above the threshold, else at the deadline, once per window."""
    d = days_with_window(windows).join(scores.withColumnRenamed("decision_day", "day"), "day", "left")
    hit = F.coalesce(F.col("score") > threshold, F.lit(False))
    before = F.coalesce(F.max(hit).over(Window.partitionBy("window_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    forced = ~before & ~hit & (F.col("day") == F.col("deadline"))
    reason = F.when(before, "already_spent").when(hit, "drift").when(forced, "forced_deadline").otherwise("below_threshold")
    return d.select("window_id", "day", "score", (~before & (hit | forced)).alias("spend"), reason.alias("reason"))


def replayed_fixed(decisions: DataFrame, windows: DataFrame, policy: str) -> DataFrame:
    """Decisions that differ from what the fixed policy decides over the same windows."""
    return replay_differences(decisions, fixed_spends(windows, policy), ["window_id", "day"], ["spend", "reason"])


def replayed_drift(decisions: DataFrame, windows: DataFrame, scores: DataFrame, threshold: float = 3.0, tolerance: float = 1e-9) -> DataFrame:
    """Decisions that differ from what the logged evidence makes of each day, in spend, reason or score."""
    return replay_differences(decisions, drift_decisions(windows, scores, threshold), ["window_id", "day"], ["spend", "reason", "score"], tolerance)


def spends_per_window(decisions: DataFrame) -> DataFrame:
    """Windows that aren't spent exactly once."""
    return decisions.groupBy("window_id").agg(F.count_if("spend").alias("n")).where("n <> 1")


def trigger_days(decisions: DataFrame, reason: str = "drift") -> DataFrame:
    return decisions.where(F.col("reason") == reason).agg(F.sort_array(F.collect_list("day")).alias("days"))


def daily_spends(spark: SparkSession, first_day: int, last_day: int, pool: DataFrame | None = None) -> DataFrame:
    """A credit every day of a range; with a pool(day), only on days when something is legal."""
    d = spark.range(first_day, last_day + 1).select(F.col("id").cast("int").alias("day"))
    return d if pool is None else d.join(pool.select("day").distinct(), "day", "left_semi")


def window_of(times: DataFrame, windows: DataFrame) -> DataFrame:
    """The window of each day; a short list of windows is broadcast."""
    return times.join(F.broadcast(windows), F.col("day").between(F.col("start_day"), F.col("end_day") - 1), "left")
