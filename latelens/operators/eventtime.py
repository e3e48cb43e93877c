"""The event-time clock as sort keys: ticks, phases, traces and their audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phases of a tick, in order.
PHASES = {"predict": 0, "deliver": 1, "reveal": 2, "emit": 3, "decide": 4}


def ticks(truth: DataFrame, tick: int, origin: int) -> DataFrame:
    """truth with predict_tick and reveal_tick: a reveal waits for its click's delivery."""
    at = lambda c: F.ceil((F.col(c) - origin) / tick)
    return truth.withColumn("predict_tick", at("click_time")).withColumn("reveal_tick", F.greatest(at("click_time"), at("available_at")))


def event_trace(truth: DataFrame, tick: int, origin: int) -> DataFrame:
    """(tick, phase, at, click_id, kind): sorting by the first four is the order of the simulation."""
    d = ticks(truth, tick, origin)
    row = lambda phase, t, at: d.select(F.col(t).alias("tick"), F.lit(PHASES[phase]).alias("phase"), F.col(at).alias("at"), "click_id", F.lit(phase).alias("kind"))
    return reduce(DataFrame.unionByName, [row("predict", "predict_tick", "click_time"), row("deliver", "predict_tick", "click_time"), row("reveal", "reveal_tick", "available_at")])


def reveals_through(truth: DataFrame, now: int) -> DataFrame:
    """Reveals that are legal by now for delivered clicks, each once, in reveal order."""
    return truth.where((F.col("available_at") <= now) & (F.col("click_time") <= now)).orderBy("available_at", "click_id")


def per_tick(trace: DataFrame) -> DataFrame:
    return trace.groupBy("tick", "kind").agg(F.count("*").alias("n"))


def audit(trace: DataFrame) -> DataFrame:
    """Clicks that are predicted twice, delivered before predicted or revealed before delivered."""
    place = F.struct("tick", "phase")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, place))
    g = trace.groupBy("click_id").agg(of("predict").alias("p"), of("deliver").alias("d"), of("reveal").alias("r"), F.count_if(F.col("kind") == "predict").alias("n"))
    bad = (F.col("n") != 1) | F.coalesce(F.col("d") < F.col("p"), F.lit(False)) | F.coalesce(F.col("r") < F.col("d"), F.lit(False)) | F.col("p").isNull()
    return g.where(bad).select("click_id", F.col("n").alias("n_predictions"))


def broken_sequence(events: DataFrame, run: str = "run_id", sequence: str = "sequence") -> DataFrame:
    """Rows whose sequence isn't dense from 0 within their run."""
    w = Window.partitionBy(run).orderBy(sequence)
    return events.withColumn("expected", F.row_number().over(w) - 1).where(F.col(sequence) != F.col("expected"))


def gaps(decisions: DataFrame, run: str, time: str, step: int) -> DataFrame:
    """Decisions that don't follow the one before by one step."""
    w = Window.partitionBy(run).orderBy(time)
    return decisions.withColumn("before", F.lag(time).over(w)).where(F.col("before").isNotNull() & (F.col(time) - F.col("before") != step))


def undrained(truth: DataFrame, now: int) -> DataFrame:
    """How much truth is still to come."""
    return truth.agg(F.count_if(F.col("available_at") > now).alias("pending"), F.count_if(F.col("available_at") <= now).alias("drained"))


def violations(truth: DataFrame, maturity: int) -> DataFrame:
    """Truth that breaks the protocol: before its click, outside the window, or not exactly mature."""
    gap = F.col("available_at") - F.col("click_time")
    reason = F.when(gap < 0, "before_click").when((F.col("final_label") == 1) & (gap > maturity), "late_positive").when((F.col("final_label") == 0) & (gap != maturity), "immature_negative")
    return truth.withColumn("reason", reason).where("reason is not null")
