"""The engine's entry points: inspect, prepare, simulate, evaluate, compare, report."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.errors import DataError, InsufficientEvidence
from latelens.operators import bootstrap, evaluation, features, ingest, strategies
from latelens.plans import simulate as simulation
from latelens.plans.config import DataConfig, FeaturePolicy, RunConfig
from latelens.sources import readers, sinks
from latelens.sources.scratch import stored

DAY = 86_400


class Strategy(Protocol):
    """A label-handling strategy: truth in, training records out."""

    def __call__(self, truth: DataFrame) -> DataFrame: ...


class Scheduler(Protocol):
    """A spending policy: windows and daily scores in, daily decisions out."""

    def __call__(self, windows: DataFrame, scores: DataFrame) -> DataFrame: ...


class LossColumns(Protocol):
    """A loss as a column of a label's and a logit's columns."""

    def __call__(self, y, z): ...


def inspect(spark: SparkSession, config: DataConfig) -> dict[str, DataFrame | dict]:
    """Validated rows, their split, profiles, histograms, the time unit, day statistics and the horizon."""
    raw = readers.read_raw_text(spark, config.path, config.header, config.separator)
    fields = list(readers.FIELDS)
    v = stored(ingest.reason_codes(raw, fields, F.col("n_fields")))
    accepted, quarantined = ingest.split_rows(v)
    p = ingest.profile(v).first()
    if not p.accepted:
        raise DataError("NO_ACCEPTED_ROWS", "every row was quarantined", parsed=p.parsed)
    candidates = ingest.time_units(p.first_click, p.last_click, p.delay_max or 0, spark, (config.min_span_days, config.max_span_days), config.max_delay_days)
    unit = ingest.inferred_unit(candidates)
    truth = truth_of(accepted, unit, int(config.max_delay_days))
    return {
        "validated": v, "accepted": accepted, "quarantined": quarantined, "profile": p.asDict() | {"time_unit": unit},
        "fields": ingest.field_profile(raw.where(F.col("n_fields") == len(fields)), fields), "reasons": ingest.reason_histogram(v),
        "failing": ingest.field_histogram(v, fields),
        "columns": raw.groupBy("n_fields").agg(F.count("*").alias("n")), "duplicates": ingest.duplicate_rows(raw, ["line"]),
        "days": ingest.day_stats(truth), "horizon": ingest.event_horizon(truth),
        "order": ingest.monotonic_violations(accepted, "raw_row_index", "click_timestamp__n"),
    }


def truth_of(accepted: DataFrame, unit: float = 1.0, maturity_days: int = 30, identity: str = "") -> DataFrame:
    """Accepted raw rows with click_id, click_time, click_day, final_label and available_at in seconds."""
    from latelens.functions.hashing import click_identity

    t = F.col("click_timestamp__n") * unit
    start = accepted.agg(F.min("click_timestamp__n")).first()[0] * unit
    won = F.col("sale_flag") == 1
    at = F.when(won, t + F.col("time_delay_for_conversion__n") * unit).otherwise(t + maturity_days * DAY)
    d = accepted.withColumn("click_id", click_identity(F.lit(identity), F.col("raw_row_index"))).withColumn("click_time", t)
    return d.withColumn("click_day", F.floor((t - start) / DAY).cast("int")).withColumn("final_label", won.cast("int")).withColumn("available_at", at)


def prepare(spark: SparkSession, accepted: DataFrame, out: str, unit: float = 1.0, policy: FeaturePolicy = FeaturePolicy()) -> dict:
    """Writes the feature store and both truth tables, reconciles them, and returns counts and statistics."""
    truth = truth_of(accepted, unit)
    d = features.prior_counts(truth, {"user": "user_id", "product": "product_id"}, ("click_time", "raw_row_index"))
    categorical = [f for f in readers.FIELDS if f in d.columns and f not in ingest.NUMBERS and f != "Sale"]
    d = features.hash_buckets(d, {f: policy.large_buckets if f in policy.large_fields else policy.small_buckets for f in categorical}, policy.seed)
    stats = {}
    for f in ("nb_clicks_1week", "product_price"):
        d = d.withColumn(f"{f}_raw", F.col(f"{f}__n"))
        stats[f] = features.fit_numeric(d.where(F.col("click_day") <= policy.burn_in_last_day), f"{f}_raw", policy.low_quantile, policy.high_quantile)
        d = features.transform_numeric(d, f"{f}_raw", stats[f]).withColumnRenamed(f"{f}_raw_value", f"{f}_value").withColumnRenamed(f"{f}_raw_missing", f"{f}_missing")
    kept = ["click_id", "click_time", *categorical, *[f"{f}_bucket" for f in categorical], *[f"{f}_{x}" for f in stats for x in ("value", "missing")]]
    kept += ["cold_user", "cold_product", "prior_user_clicks", "prior_product_clicks", "click_day"]
    if leaked := features.leaked_columns(kept):
        raise DataError("LEAKED_COLUMNS", ", ".join(leaked))
    sinks.write_days(d.select(*kept), f"{out}/features")
    sinks.write_truth(truth, f"{out}/truth", DAY, int(truth.agg(F.min("click_time")).first()[0]))
    got = features.reconcile(spark.read.parquet(f"{out}/features"), readers.read_truth(spark, f"{out}/truth", 0, 1 << 20)).first().asDict()
    if any(got.values()):
        raise DataError("TRUTH_MISMATCH", "features and truth differ", **got)
    return {"statistics": stats, "reconciliation": got, "rows": readers.count_rows(spark, f"{out}/features")}


def simulate(truth: DataFrame, config: RunConfig) -> dict:
    """Predictions, credits and the final model of one strategy over truth(click_id, click_time, feature,
    final_label, available_at)."""
    known = strategies.strategies(config.wait_seconds, config.maturity_seconds)
    if config.strategy not in known:
        raise DataError("UNKNOWN_STRATEGY", config.strategy)
    return simulation.run(truth, known[config.strategy](truth), list(config.decision_times), config.steps_per_credit, config.learning_rate)


def evaluate(examples: DataFrame, min_rows: int = 10_000, min_positives: int = 100) -> dict[str, DataFrame | tuple | None]:
    """Metrics, ranking, reliability with its error, calibration and slices of evaluation examples."""
    bad = evaluation.example_violations(examples).first().asDict()
    if any(bad.values()):
        raise DataError("INVALID_EXAMPLES", "examples break their invariants", **bad)
    examples = stored(examples)
    r = evaluation.reliability(examples)
    return {
        "metrics": evaluation.point_metrics(examples), "ranking": evaluation.ranking_metrics(examples), "reliability": r,
        "calibration_error": evaluation.calibration_error(r), "calibration": evaluation.calibration_fit(examples),
        "slices": evaluation.slices(examples, min_rows, min_positives),
    }


def compare(control: DataFrame, candidate: DataFrame, replicates: int = bootstrap.MIN_REPLICATES, seed: int = 17) -> list[dict]:
    """Differences and intervals of two methods over the same clicks and seeds."""
    keys = ["seed", "click_id"] if "click_id" in control.columns else ["seed"]
    if len(keys) == 2 and (control.select(*keys).exceptAll(candidate.select(*keys)).limit(1).count() or candidate.select(*keys).exceptAll(control.select(*keys)).limit(1).count()):
        raise DataError("UNPAIRED_ROWS", "both methods need the same clicks in every seed")
    if control.select("seed").distinct().count() < 3:
        raise InsufficientEvidence("TOO_FEW_SEEDS", "a comparison wants three seeds")
    return bootstrap.compare(control, candidate, replicates, seed)


def report(tables: dict[str, DataFrame | None], kind: str = "html") -> str:
    return sinks.render(tables, kind)


def reproduce(spark: SparkSession, path: str, ledgers: dict[str, DataFrame]) -> list[str]:
    """Names of the ledgers in which a run that was made anew differs from the one written at path."""
    return sinks.changed_ledgers(spark, path, ledgers)
