"""Streaming twins of the label strategies.

Truth arrives as a stream of events (kind, click_id, time): clicks and conversions. Records leave as
soon as they are legal. Stateless parts stay expressions; what must wait for a click's maturity keeps
one small state per click until then. Events behind the watermark, and conversions whose click can't come
any more, are records of kinds of their own (SIDE), which append_to writes to a side table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORDS = "click_id string, available_at timestamp, kind string, target double, method string"
STATE = "click_time double, conversion double, provisional boolean, done boolean"


def immediate_fake_negative(events: DataFrame) -> DataFrame:
    """A negative at each click and a correction at each conversion: no state at all."""
    kind = F.when(F.col("kind") == "click", "PROVISIONAL").otherwise("CORRECTION")
    return events.select("click_id", F.col("time").alias("available_at"), kind.alias("kind"), (F.col("kind") != "click").cast("double").alias("target"), F.lit("immediate_fake_negative").alias("method"))


def join_conversions(clicks: DataFrame, conversions: DataFrame, maturity_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Clicks with their conversion within maturity, null once that has passed: a stream-stream outer
    join whose watermark lets state go after maturity."""
    c = clicks.withWatermark("click_time", lateness).alias("c")
    v = conversions.withWatermark("conversion_time", lateness).alias("v")
    within = F.expr(f"v.conversion_time >= c.click_time and v.conversion_time <= c.click_time + interval {maturity_seconds} seconds")
    return c.join(v, (F.col("c.click_id") == F.col("v.click_id")) & within, "left_outer").select("c.click_id", "c.click_time", "v.conversion_time")


#: Kinds of what a run must not train on: an event behind the watermark, and a conversion without its click.
SIDE = ("LATE", "ORPHAN")


def fixed_wait(events: DataFrame, wait_seconds: float, maturity_seconds: float, lateness_seconds: int = 3_600) -> DataFrame:
    """Early positives at their reveal, negatives at the end of the wait, corrections after it.

    State per click lives until its maturity has passed by the watermark, which is the greatest time seen
    before a batch less lateness_seconds; that of a conversion without a click until the watermark reaches
    it. Spark's own watermark lags by a maturity, so that events behind the watermark are still seen and
    told as LATE; only those later than that are dropped, and counted, by Spark. Times begin at the epoch."""
    lag = float(maturity_seconds)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        click, conversion, provisional, done = state.get if state.exists else (None, None, False, False)
        out: list[tuple] = []
        stamp = lambda s: pd.Timestamp(s, unit="s")
        behind = state.getCurrentWatermarkMs() / 1000
        now = behind + lag if behind > 0 else float("-inf")
        for f in frames:
            for kind, t in sorted(zip(f["kind"], f["time"].astype("datetime64[us]").astype("int64") / 1e6), key=lambda x: x[1]):
                if t < now:
                    out.append((key[0], stamp(t), "LATE", None, "fixed_wait"))
                elif kind == "click" and click is None:
                    click = t
                elif kind == "conversion" and conversion is None:
                    conversion = t
        if click is not None and not done:
            due = click + wait_seconds
            if conversion is not None and conversion <= due:
                out.append((key[0], stamp(conversion), "EARLY_POSITIVE", 1.0, "fixed_wait"))
                done = True
            elif not provisional and (conversion is not None or now >= due):
                out.append((key[0], stamp(due), "PROVISIONAL", 0.0, "fixed_wait"))
                provisional = True
            if not done and conversion is not None and due < conversion <= click + maturity_seconds:
                out.append((key[0], stamp(conversion), "CORRECTION", 1.0, "fixed_wait"))
                done = True
        ends = click + maturity_seconds if click is not None else conversion
        if ends is None or now >= ends:
            if click is None and conversion is not None:
                out.append((key[0], stamp(conversion), "ORPHAN", None, "fixed_wait"))
            if state.exists:
                state.remove()
        else:
            state.update((click, conversion, provisional, done))
            wake = ends if click is None or provisional or done else click + wait_seconds
            state.setTimeoutTimestamp(int(max(wake - lag, behind + 0.001) * 1000) + 1)
        d = pd.DataFrame(out, columns=["click_id", "available_at", "kind", "target", "method"])
        yield d.astype({"target": "float64", "available_at": "datetime64[ns]"})

    # a millisecond on, since Spark takes what stands at its first watermark, the epoch, for late
    timed = events.withColumn("clock", F.col("time") + F.expr("interval 1 millisecond")).withWatermark("clock", f"{int(lateness_seconds + lag)} seconds")
    return timed.groupBy("click_id").applyInPandasWithState(step, RECORDS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def complete_wait(clicks: DataFrame, conversions: DataFrame, maturity_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """One final record per click when its maturity has passed."""
    j = join_conversions(clicks, conversions, maturity_seconds, lateness)
    at = F.col("click_time") + F.expr(f"interval {maturity_seconds} seconds")
    return j.select("click_id", at.alias("available_at"), F.lit("FINAL").alias("kind"), F.col("conversion_time").isNotNull().cast("double").alias("target"), F.lit("complete_wait").alias("method"))


def tick_counts(events: DataFrame, tick: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events per tumbling tick and kind."""
    return events.withWatermark("time", lateness).groupBy(F.window("time", tick), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("tick"), "kind", "n")


def append_to(records: DataFrame, path: str, checkpoint: str, side: str | None = None):
    """Starts a query that appends records and stops when what is there has been read.

    With side, records of the SIDE kinds go there instead; then each batch has a folder of its own in
    both tables, which a batch that is run again replaces."""
    w = records.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    if side is None:
        return w.format("parquet").start(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        aside = F.col("kind").isin(*SIDE)
        for to, rows in ((path, ~aside), (side, aside)):
            batch.where(rows).write.mode("overwrite").parquet(f"{to}/batch={number}")
        batch.unpersist()

    return w.foreachBatch(write).start()
