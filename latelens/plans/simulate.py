"""Simulations: a set-oriented ledger and a short loop over credits.

Everything that doesn't depend on a model is one job; the loop runs once per credit, over the records
that are legal by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.errors import IntegrityError
from latelens.functions.numeric import clipped
from latelens.operators import learners, states, strategies
from latelens.operators.evaluation import point_metrics
from latelens.plans.experiments import plan_id
from latelens.sources.scratch import stored


def run(truth: DataFrame, records: DataFrame, decisions: list[int], steps: int, rate: float, tick: int = 3600, start: tuple[float, float] = (0.0, 0.0), state: dict | None = None, stop_after: int | None = None) -> dict:
    """Predictions, credits and the final model of a one-feature learner.

    A click is predicted at its tick with the model of all credits decided before it; a decision at
    time d sees the records available by d. Ticks, not seconds, order predictions and decisions.

    The result's state (plain numbers, for a RollingStore) lets a later call of the same run go on behind the
    decisions that are done; stop_after ends a call after so many decisions in all."""
    identity = plan_id({"decisions": decisions, "steps": steps, "rate": rate, "tick": tick, "start": list(start)})
    if state is not None and state["identity"] != identity:
        raise IntegrityError("STATE_MISMATCH", "the state is of another run")
    models = [tuple(m) for m in state["models"]] if state else [(None, *start, 0)]
    credits, done = (list(state["credits"]), state["done"]) if state else ([], 0)
    _, w, b, version = models[-1]
    feature = truth.select("click_id", "feature")
    ledger = records.join(feature, "click_id").withColumn("weight", F.lit(1.0)).cache()
    end = len(decisions) if stop_after is None else min(stop_after, len(decisions))
    for d in decisions[done:end]:
        legal = strategies.legal_at(ledger, d)
        n = legal.count()
        if n:
            w, b = learners.spend_credit(legal, w, b, steps, rate)
            version += steps
            credits.append({"decision_time": d, "steps": steps, "examples": n * steps})
            models.append((d, w, b, version))
    ledger.unpersist()
    state = {"identity": identity, "done": max(done, end), "models": [list(m) for m in models], "credits": credits}
    spark = truth.sparkSession
    m = spark.createDataFrame([(i, -(1 << 62) if t is None else int(t), float(x), float(y), v) for i, (t, x, y, v) in enumerate(models)], "i int, since long, w double, b double, model_version int")
    # the short table of models is broadcast; a click takes the last one decided at an earlier tick
    at = F.ceil(F.col("click_time") / tick) * tick
    j = truth.withColumn("at", at).join(F.broadcast(m), F.col("since") < F.col("at")).groupBy("click_id").agg(F.max_by(F.struct("w", "b", "model_version"), "i").alias("m"))
    p = truth.join(j, "click_id").select("click_id", "click_time", "final_label", learners.predict(F.col("feature"), 0.0, 0.0).alias("x"), "feature", "m")
    z = F.col("m.w") * F.col("feature") + F.col("m.b")
    p = p.select("click_id", "click_time", "final_label", (1 / (1 + F.exp(-z))).alias("probability"), F.col("m.model_version").alias("model_version"))
    return {"predictions": p, "credits": credits, "weight": w, "bias": b, "version": version, "state": state}


@dataclass(frozen=True)
class Calendar:
    """Days of a study; one day is unit of the truth's time, counted from origin."""

    origin: int = 0
    unit: int = 86_400
    maturity_days: int = 30
    first_decision: int = 31
    seal: int = 90
    drain: int = 120
    train_last: int = 24
    score: tuple[int, int] = (25, 34)
    credits: tuple[int, int] = (55, 64)

    def at(self, day: int) -> int:
        return self.origin + day * self.unit


def initialised(truth: DataFrame, members: DataFrame, calendar: Calendar, steps: int, rate: float) -> tuple[float, float]:
    """The model that all runs share: fitted on the clicks of day 0 outside the monitoring sample, which are mature at the first decision."""
    now = calendar.at(calendar.first_decision)
    first = truth.where((F.col("click_day") == 0) & (F.col("click_time") + calendar.maturity_days * calendar.unit <= now) & (F.col("available_at") <= now))
    first = first.join(members.select("click_id"), "click_id", "left_anti")
    records = first.select("feature", F.col("final_label").cast("double").alias("target"), F.lit(1.0).alias("weight"))
    if not records.limit(1).count():
        raise IntegrityError("EMPTY_COHORT", "no mature click of day 0")
    return learners.spend_credit(records, 0.0, 0.0, steps, rate)


def final_run(truth: DataFrame, members: DataFrame, records: DataFrame, spend_days: list[int], steps: int, rate: float, calendar: Calendar = Calendar(), tick: int = 3600, state: dict | None = None) -> dict:
    """A final run: the shared start, credits on spend_days, predictions of the days from the first decision to the
    seal, and only then the truth, which must be drained by its day.

    Clicks of the monitoring sample never train. evaluation holds the sealed predictions beside their truth."""
    if any(not calendar.first_decision <= d < calendar.seal for d in spend_days):
        raise ValueError("credits are spent from the first decision's day to the seal")
    start = initialised(truth, members, calendar, steps, rate)
    own = records.join(members.select("click_id"), "click_id", "left_anti")
    out = run(truth, own, [calendar.at(d) for d in spend_days], steps, rate, tick, start, state)
    days = truth.select("click_id", "click_day").where(F.col("click_day").between(calendar.first_decision, calendar.seal - 1))
    p = stored(out["predictions"].drop("final_label", "click_time").join(days, "click_id"))
    bad = states.prediction_violations(p).first().asDict()
    if any(bad.values()):
        raise IntegrityError("BAD_PREDICTIONS", "the ledger can't be sealed", **bad)
    shown = truth.where(F.col("click_day").between(calendar.first_decision, calendar.seal - 1))
    return out | {"predictions": p, "evaluation": states.sealed_with_truth(p, shown, calendar.at(calendar.drain)), "start": start}


def selection_run(truth: DataFrame, members: DataFrame, records: DataFrame, steps: int, rate: float, calendar: Calendar = Calendar(), state: dict | None = None) -> dict:
    """A candidate's run: a credit a day over records of early clicks, then its last model scores the held-out days."""
    early = truth.where(F.col("click_day") <= calendar.train_last).select("click_id").join(members.select("click_id"), "click_id", "left_anti")
    days = [calendar.at(d) for d in range(calendar.credits[0], calendar.credits[1] + 1)]
    out = run(truth, records.join(early, "click_id", "left_semi"), days, steps, rate, state=state)
    held = truth.where(F.col("click_day").between(*calendar.score))
    p = stored(held.select("click_id", "click_day", learners.predict(F.col("feature"), out["weight"], out["bias"]).alias("probability")))
    return out | {"predictions": p, "evaluation": states.sealed_with_truth(p, held, calendar.at(calendar.credits[1] + 1))}


def synthetic(spark: SparkSession, rate: float = 0.1, steps: int = 4) -> dict:
    """The boundary fixture with mature outcomes and a credit a day."""
    from latelens.sources.readers import DAY, boundary_fixture

    t = boundary_fixture(spark)
    out = run(t, strategies.mature_outcome(t), [DAY, 2 * DAY], steps, rate)
    out["metrics"] = point_metrics(out["predictions"].withColumn("probability", clipped(F.col("probability"))))
    return out


def study_a(spark: SparkSession, rate: float = 0.1, steps: int = 2) -> dict[str, dict]:
    """All strategies on one fixture, with equal schedules and budgets."""
    from latelens.sources.readers import DAY, study_a_fixture

    t = study_a_fixture(spark).cache()
    days = [31 * DAY, 32 * DAY, 33 * DAY]
    make = strategies.strategies(DAY, 30 * DAY)
    return {k: run(t, make[k](t), days, steps, rate) for k in ("complete_wait", "immediate_fake_negative", "fixed_wait", "dfm", "fnw", "es_dfm", "oracle_reference")}


def study_b(spark: SparkSession, probability: float = 0.5, threshold: float = 3.0) -> dict[str, DataFrame]:
    """Decisions of the fixed and the drift-triggered policies over the same windows."""
    from latelens.operators import scheduling
    from latelens.sources.readers import monitoring_fixture

    w = scheduling.credit_windows(spark)
    out = {p: scheduling.fixed_spends(w, p) for p in ("early", "midpoint", "deadline")}
    m = monitoring_fixture(spark).withColumn("probability", F.lit(probability))
    days = spark.range(31, 90).select(F.col("id").cast("int").alias("decision_day"))
    out["drift"] = scheduling.drift_decisions(w, scheduling.evidence(m, days), threshold)
    return out
