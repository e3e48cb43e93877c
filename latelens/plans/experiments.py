"""Experiment plans, locks, rolling checkpoints and snapshots."""

from __future__ import annotations

import hashlib
import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.errors import IntegrityError
from latelens.operators import protocol
from latelens.sources.sinks import canonical, write_object


def plan_id(plan: dict) -> str:
    return hashlib.sha256(canonical(plan)).hexdigest()


def stage_plans(axes: dict[str, list], stage: str, base: dict | None = None) -> list[dict]:
    """All combinations of a stage's axes beside what earlier stages decided, each with its id."""
    plans: list[dict] = [{}]
    for name, values in axes.items():
        plans = [p | {name: v} for p in plans for v in values]
    out = [{"stage": stage} | (base or {}) | p for p in plans]
    return [p | {"plan_id": plan_id(p)} for p in out]


def run_stages(spark: SparkSession, stages: list[tuple[str, dict[str, list]]], score) -> dict:
    """Stage after stage: freeze all plans, score all, pick one, carry it on.

    score(plans) gives a DataFrame (plan_id, loss, compute_seconds, parameters, status)."""
    chosen: dict = {}
    for stage, axes in stages:
        plans = stage_plans(axes, stage, chosen)
        rows = score(plans).withColumn("stage", F.lit(stage)).withColumn("digest", F.col("plan_id"))
        won = protocol.select_candidate(rows).first()
        if won is None:
            raise IntegrityError("STAGE_BLOCKED", stage)
        best = next(p for p in plans if p["plan_id"] == won["plan_id"])
        chosen |= {k: best[k] for k in axes}
    return chosen


#: Methods and policies of the two studies.
STUDY_A = ("complete_wait", "immediate_fake_negative", "fixed_wait", "dfm", "fnw", "es_dfm", "oracle_reference")
STUDY_B = ("early", "midpoint", "deadline", "drift")


def final_matrix(spark: SparkSession, seeds: tuple[int, ...] = (17, 29, 43)) -> DataFrame:
    """(study, method, seed): all online runs, and the offline references."""
    rows = [(s, m) for s, ms in (("a", STUDY_A), ("b", STUDY_B), ("offline", ("logistic", "boosted"))) for m in ms]
    d = spark.createDataFrame(rows, "study string, method string")
    return d.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))


def snapshots(credits: int, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> list[int]:
    """Credits after which a snapshot is due."""
    return [math.ceil(f * credits) for f in fractions]


def verified_snapshots(found: DataFrame, credits: int, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """found(run_id, credit): runs and credits whose snapshots are missing, repeated or not asked for."""
    due = snapshots(credits, fractions)
    want = found.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(c) for c in due])).alias("credit"))
    n = found.groupBy("run_id", "credit").agg(F.count("*").alias("n")).join(want.withColumn("due", F.lit(True)), ["run_id", "credit"], "full_outer")
    what = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return n.select("run_id", "credit", what.alias("difference")).where("difference is not null")


def write_lock(path: str, decisions: dict, inputs: dict[str, str]) -> str:
    """Decisions with the digests of what they rest on; a lock is never replaced."""
    return write_object(path, {"decisions": decisions, "inputs": inputs, "digest": plan_id({"d": decisions, "i": inputs})})


def verified_lock(path: str, inputs: dict[str, str]) -> dict:
    with open(path, encoding="utf-8") as f:
        lock = json.load(f)
    if lock["inputs"] != inputs or lock["digest"] != plan_id({"d": lock["decisions"], "i": lock["inputs"]}):
        raise IntegrityError("LOCK_MISMATCH", path)
    return lock["decisions"]


class RollingStore:
    """Two generations of a small state: a write replaces the older one, a damaged one falls back."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, generation: int) -> str:
        return os.path.join(self.folder, f"state-{generation % 2}.json")

    def write(self, generation: int, state: dict) -> None:
        body = {"generation": generation, "state": state}
        write_object(self._path(generation), body | {"digest": plan_id(body)}, overwrite=True)

    def load(self) -> tuple[int, dict] | None:
        best = None
        for g in (0, 1):
            try:
                with open(self._path(g), encoding="utf-8") as f:
                    x = json.load(f)
                body = {"generation": x["generation"], "state": x["state"]}
                if x["digest"] == plan_id(body) and (best is None or body["generation"] > best[0]):
                    best = (body["generation"], body["state"])
            except (FileNotFoundError, ValueError, KeyError):
                continue
        return best


def projected_cost(options: DataFrame, runs: DataFrame, seconds_per_step: float, fixed_seconds: float, caps: dict[str, float], bytes_per_credit: float, multiplier: float = 1.5) -> DataFrame:
    """Per steps-per-credit option: projected hours and bytes over all runs, and whether all caps hold."""
    credits = runs.agg(F.sum("credits").alias("credits"))
    d = options.join(F.broadcast(credits.withColumn("__k", F.lit(1))), F.lit(1) == F.col("__k")).drop("__k")
    d = d.withColumn("hours", (F.col("steps_per_credit") * F.col("credits") * seconds_per_step + fixed_seconds) * multiplier / 3600)
    d = d.withColumn("bytes", F.col("credits") * bytes_per_credit * multiplier)
    return d.withColumn("fits", (F.col("hours") <= caps["hours"]) & (F.col("bytes") <= caps["bytes"]))
