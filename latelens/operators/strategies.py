"""Label-handling strategies as set-oriented record streams.

A strategy maps truth(click_id, click_time, final_label, available_at) to training records
(click_id, available_at, kind, target, method): what a state machine would emit click by click is a
union of projections, since each record's legal time is a closed form of its click.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the record kinds.
KINDS = {"FINAL": 0, "PROVISIONAL": 1, "CORRECTION": 2, "EARLY_POSITIVE": 3, "DFM_CLICK": 4, "ORACLE_FINAL": 5}


def _records(truth: DataFrame, method: str, kind: str, at: Column, target: Column, where: Column | None = None) -> DataFrame:
    d = truth if where is None else truth.where(where)
    return d.select("click_id", at.alias("available_at"), F.lit(kind).alias("kind"), target.cast("double").alias("target"), F.lit(method).alias("method"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _is(label: int) -> Column:
    return F.col("final_label") == label


def complete_wait(truth: DataFrame, maturity: int, method: str = "complete_wait") -> DataFrame:
    """One final record per click, once its maturity has passed."""
    return _records(truth, method, "FINAL", F.col("click_time") + maturity, F.col("final_label"))


def immediate_fake_negative(truth: DataFrame, method: str = "immediate_fake_negative") -> DataFrame:
    """A negative at the click, corrected at the reveal."""
    return _union(
        _records(truth, method, "PROVISIONAL", F.col("click_time"), F.lit(0)),
        _records(truth, method, "CORRECTION", F.col("available_at"), F.lit(1), _is(1)),
    )


def fnw(truth: DataFrame) -> DataFrame:
    """The same stream; weights come at exposure."""
    return immediate_fake_negative(truth, "fnw")


def fixed_wait(truth: DataFrame, wait: int, method: str = "fixed_wait") -> DataFrame:
    """Positives within the wait at their reveal; the others a negative then, corrected later."""
    due = F.col("click_time") + wait
    early = _is(1) & (F.col("available_at") <= due)
    return _union(
        _records(truth, method, "EARLY_POSITIVE", F.col("available_at"), F.lit(1), early),
        _records(truth, method, "PROVISIONAL", due, F.lit(0), ~early),
        _records(truth, method, "CORRECTION", F.col("available_at"), F.lit(1), _is(1) & (F.col("available_at") > due)),
    )


def es_dfm(truth: DataFrame, wait: int) -> DataFrame:
    return fixed_wait(truth, wait, "es_dfm")


def es_auxiliary(truth: DataFrame, wait: int, maturity: int) -> DataFrame:
    """Targets of the two auxiliary models at maturity; early positives have no true-negative target."""
    early = _is(1) & (F.col("available_at") <= F.col("click_time") + wait)
    late = _is(1) & ~early
    at = F.col("click_time") + maturity
    return _union(
        truth.select("click_id", at.alias("available_at"), F.lit("q_dp").alias("model"), late.cast("int").alias("target")),
        truth.where(~early).select("click_id", at.alias("available_at"), F.lit("q_tn").alias("model"), (~late).cast("int").alias("target")),
    )


def dfm(truth: DataFrame) -> DataFrame:
    """One record at the click; its target is read off at the decision (dfm_asof)."""
    return _records(truth, "dfm", "DFM_CLICK", F.col("click_time"), F.lit(0))


def dfm_asof(truth: DataFrame, decisions: DataFrame, maturity: int) -> DataFrame:
    """What is known of each click delivered by each decision_time.

    decisions is a short list of times; it is broadcast as one."""
    j = F.broadcast(decisions).join(truth, F.col("click_time") <= F.col("decision_time"))
    seen = _is(1) & (F.col("available_at") <= F.col("decision_time"))
    done = F.col("decision_time") >= F.col("click_time") + maturity
    status = F.when(seen, "revealed_positive").when(done & _is(0), "mature_negative").otherwise("right_censored")
    elapsed = F.when(seen, F.col("available_at") - F.col("click_time")).otherwise(F.least(F.col("decision_time") - F.col("click_time"), F.lit(maturity)))
    return j.select("decision_time", "click_id", status.alias("status"), elapsed.alias("elapsed"))


def oracle_reference(truth: DataFrame) -> DataFrame:
    """The final label at the click; never to be ranked."""
    return _records(truth, "oracle_reference", "FINAL", F.col("click_time"), F.col("final_label"))


def mature_outcome(truth: DataFrame) -> DataFrame:
    return _records(truth, "mature_outcome", "FINAL", F.col("available_at"), F.col("final_label"))


def strategies(wait: int, maturity: int) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """All strategies by name; extend by adding an entry."""
    return {
        "complete_wait": lambda t: complete_wait(t, maturity),
        "immediate_fake_negative": immediate_fake_negative,
        "fixed_wait": lambda t: fixed_wait(t, wait),
        "dfm": dfm,
        "fnw": fnw,
        "es_dfm": lambda t: es_dfm(t, wait),
        "oracle_reference": oracle_reference,
        "mature_outcome": mature_outcome,
    }


def legal_at(records: DataFrame, now: int) -> DataFrame:
    return records.where(F.col("available_at") <= now)


def future_records(records: DataFrame, now: int) -> DataFrame:
    """Records that were used before they may be."""
    return records.where(F.col("available_at") > now)


def ordered(records: DataFrame) -> DataFrame:
    """Emission order: time, kind's code, click."""
    code = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return records.withColumn("kind_code", code[F.col("kind")]).orderBy("available_at", "kind_code", "click_id")


def duplicate_records(records: DataFrame) -> DataFrame:
    return records.groupBy("click_id", "kind").agg(F.count("*").alias("n")).where("n > 1")
