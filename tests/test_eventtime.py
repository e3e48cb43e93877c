from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from latelens.operators import eventtime, features, sampling, scheduling, strategies
from latelens.plans import simulate
from latelens.sources import readers

DAY = 86_400


def test_fixed_wait_sequence(spark):
    t = spark.createDataFrame([("a", 0, 1, DAY), ("b", DAY // 2, 1, int(1.6 * DAY)), ("c", DAY, 0, 31 * DAY)], "click_id string, click_time long, final_label int, available_at long")
    got = [(r.click_id, r.kind, r.available_at) for r in strategies.ordered(strategies.fixed_wait(t, DAY)).collect()]
    assert got == [("a", "EARLY_POSITIVE", DAY), ("b", "PROVISIONAL", 3 * DAY // 2), ("b", "CORRECTION", int(1.6 * DAY)), ("c", "PROVISIONAL", 2 * DAY)]


def test_complete_wait_withholds_positives(spark):
    r = strategies.complete_wait(readers.boundary_fixture(spark), 30 * DAY)
    assert r.count() == 6 and r.where(F.col("available_at") < 30 * DAY).count() == 0


def test_auxiliary_targets(spark):
    t = spark.createDataFrame([("early", 0, 1, 10), ("late", 0, 1, 2 * DAY), ("no", 0, 0, 30 * DAY)], "click_id string, click_time long, final_label int, available_at long")
    got = {(r.click_id, r.model): r.target for r in strategies.es_auxiliary(t, DAY, 30 * DAY).collect()}
    assert got == {("early", "q_dp"): 0, ("late", "q_dp"): 1, ("no", "q_dp"): 0, ("late", "q_tn"): 0, ("no", "q_tn"): 1}


def test_trace_is_legal_and_audit_finds_mutations(spark):
    t = readers.boundary_fixture(spark)
    trace = eventtime.event_trace(t, 3600, 0)
    assert trace.count() == 18 and eventtime.audit(trace).count() == 0
    early = trace.withColumn("tick", F.when((F.col("kind") == "reveal") & (F.col("click_id") == "click-004"), -1).otherwise(F.col("tick")))
    assert [r.click_id for r in eventtime.audit(early).collect()] == ["click-004"]
    twice = trace.unionByName(trace.where("kind = 'predict' and click_id = 'click-000'"))
    assert eventtime.audit(twice).count() == 1


def test_same_tick_reveal_follows_delivery(spark):
    t = eventtime.event_trace(readers.boundary_fixture(spark), 3600, 0).where("click_id = 'click-002'").orderBy("tick", "phase").collect()
    assert [r.kind for r in t] == ["predict", "deliver", "reveal"] and len({r.tick for r in t}) == 1


def test_boundaries_of_reveals(spark):
    t = spark.createDataFrame([("p", 0, 1, 100), ("n", 0, 0, 200)], "click_id string, click_time long, final_label int, available_at long")
    assert [eventtime.reveals_through(t, x).count() for x in (99, 100, 199, 200)] == [0, 1, 1, 2]


def test_leaks(spark):
    assert features.leaked_columns(["Sale", "user_id", "time_delay_for_conversion"]) == ["Sale", "time_delay_for_conversion"]
    with pytest.raises(ValueError):
        features.check_model_columns(["a_bucket", "x"], ["a_bucket"])
    r = spark.createDataFrame([("a", 10)], "click_id string, available_at long")
    assert strategies.future_records(r, 9).count() == 1 and strategies.future_records(r, 10).count() == 0


def test_synthetic_golden(spark):
    got = simulate.synthetic(spark)
    p = [r.probability for r in got["predictions"].orderBy("click_id").collect()]
    assert p == pytest.approx([0.5, 0.5, 0.5, 0.5987622496536608, 0.49423307353671647, 0.5492341105794886], abs=1e-12)
    m = got["metrics"].first()
    assert m.log_loss == pytest.approx(0.6784697858888467, abs=1e-12) and m.brier == pytest.approx(0.24281936191743045, abs=1e-12)
    assert [c["examples"] for c in got["credits"]] == [8, 12]
    assert (got["weight"], got["bias"]) == pytest.approx((0.29383838502595, 0.34449586152101), abs=1e-12)


def test_study_a_budgets(spark):
    t = readers.study_a_fixture(spark)
    assert t.count() == 136
    r = strategies.strategies(DAY, 30 * DAY)["fixed_wait"](t)
    got = simulate.run(t, r, [31 * DAY, 32 * DAY, 33 * DAY], 2, 0.1)
    assert [c["steps"] for c in got["credits"]] == [2, 2, 2]


def test_windows(spark):
    w = scheduling.credit_windows(spark).orderBy("window_id").collect()
    assert len(w) == 12 and (w[0].early, w[0].midpoint, w[0].deadline) == (31, 34, 35)
    assert (w[-1].start_day, w[-1].end_day, w[-1].deadline) == (86, 90, 89)
    d = scheduling.fixed_spends(scheduling.credit_windows(spark), "deadline")
    assert (d.count(), d.where("spend").count()) == (59, 12)


def test_evidence_and_drift(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("click_id"), F.lit(0).alias("click_day"), F.lit(1).alias("final_label"), F.lit(0.5).alias("probability"))
    days = spark.createDataFrame([(31,), (39,)], "decision_day int")
    e = {r.decision_day: r for r in scheduling.evidence(rows, days).collect()}
    assert (e[31].n, e[31].bin) == (1000, 5) and e[31].score == pytest.approx(500 / (250 + 1e-8) ** 0.5)
    assert (e[39].n, e[39].score) == (0, None)
    w = scheduling.credit_windows(spark)
    d = scheduling.drift_decisions(w, scheduling.evidence(rows, days)).orderBy("day").collect()
    assert [(x.day, x.reason) for x in d[:2]] == [(31, "drift"), (32, "already_spent")]
    assert [x.day for x in d if x.spend][1] == 40 and d[9].reason == "forced_deadline"
    assert scheduling.spends_per_window(spark.createDataFrame([tuple(x) for x in d], "window_id int, day int, score double, spend boolean, reason string")).count() == 0


def test_sampler(spark):
    r = spark.createDataFrame([(f"r{i}", f"c{i}", i) for i in range(10)], "record_id string, click_id string, available_at long")
    p = sampling.pools(r, 9, 3, 4, 17)
    assert {x.pool: x.n for x in p.groupBy("pool").agg(F.count("*").alias("n")).collect()} == {"recent": 4, "reservoir": 4}
    b = sampling.batch(p, 8, 1)
    assert b.groupBy("pool").count().orderBy("pool").collect()[0]["count"] == 4 and b.count() == 8
    assert sampling.pools(r, 9, 20, 4, 17).where("pool = 'recent'").count() == 10
    out = sampling.pools(r, 9, 3, 4, 17, r.where("click_id = 'c9'").select("click_id"))
    assert out.where("click_id = 'c9'").count() == 0
    with pytest.raises(ValueError, match="INSUFFICIENT"):
        sampling.batch(p.limit(0), 8, 1)
