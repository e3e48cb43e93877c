"""Stores, ledgers, cursors, replays and controllers on small tables."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from latelens import api
from latelens.errors import IntegrityError
from latelens.functions.hashing import is_member
from latelens.operators import scheduling, states, strategies
from latelens.plans import experiments, simulate
from latelens.sources import readers, sinks

DAY = 86_400


def test_publish_all_or_nothing(spark, tmp_path):
    to = str(tmp_path / "out")

    def broken(folder):
        spark.range(3).write.parquet(f"{folder}/a")
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        sinks.published(spark, to, broken)
    assert os.listdir(tmp_path) == []
    sinks.published(spark, to, lambda folder: spark.range(3).write.parquet(f"{folder}/a"))
    assert spark.read.parquet(f"{to}/a").count() == 3 and [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["out"]
    with pytest.raises(IntegrityError, match="EXISTS"):
        sinks.published(spark, to, lambda folder: None)


def test_materialised_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(4)

    for _ in range(2):
        assert sinks.materialised(spark, str(tmp_path), {"seed": 1}, make).count() == 4
    sinks.materialised(spark, str(tmp_path), {"seed": 2}, make)
    assert len(made) == 2


def test_run_is_reproduced(spark, tmp_path):
    make = lambda x: {k: spark.createDataFrame([(1, x, None), (1, x, None), (2, 0.5, "a")], "i int, p double, s string") for k in sinks.LEDGERS}
    m = sinks.write_run(spark, str(tmp_path / "run"), make(0.25), {"seed": 17})
    assert m["ledgers"]["events"]["rows"] == 3 and m["facts"] == {"seed": 17}
    other = make(0.25)
    other["credits"] = other["credits"].distinct()
    other["events"] = other["events"].orderBy(F.desc("i"))
    assert api.reproduce(spark, str(tmp_path / "run"), make(0.25)) == []
    assert api.reproduce(spark, str(tmp_path / "run"), other) == ["credits"]
    with pytest.raises(ValueError):
        sinks.write_run(spark, str(tmp_path / "two"), {"events": other["events"]}, {})


def test_exposures_are_whole_batches(spark, tmp_path):
    ledger = sinks.ExposureLedger(spark, str(tmp_path / "e"), 4)
    rows = lambda credit, n: spark.range(2).selectExpr(f"{credit} as credit_id", "id as step", f"explode(sequence(0, {n - 1})) as draw")
    ledger.append(0, rows(0, 4))
    with pytest.raises(IntegrityError, match="BATCH_SIZE"):
        ledger.append(1, rows(1, 3))
    with pytest.raises(IntegrityError, match="WRONG_CREDIT"):
        ledger.append(1, rows(2, 4))
    ledger.append(1, rows(1, 4))
    assert ledger.seal()["rows"] == 16


def test_collection_and_tables(spark, tmp_path):
    with pytest.raises(IntegrityError, match="NOT_AGGREGATE"):
        sinks.write_collection(str(tmp_path / "c.json"), {"clicks": {"rows": 1}}, ("metrics",))
    sinks.write_collection(str(tmp_path / "c.json"), {"metrics": {"rows": 1, "digest": "x"}}, ("metrics",))
    got = sinks.write_tables({"methods": spark.createDataFrame([("dfm", [1, 2])], "m string, l array<int>")}, str(tmp_path / "t"))
    assert len(got) == 10 and (tmp_path / "t" / "methods.csv").read_text() == "m,l\ndfm,1;2\n"
    assert (tmp_path / "t" / "slices.csv").read_text() == "status\nnot_available\n"
    assert got[0]["sha256"] == hashlib.sha256(b"m,l\ndfm,1;2\n").hexdigest()


def test_days_are_split_by_size_and_tagged(spark, tmp_path):
    d = sinks.tagged(spark.range(1000).selectExpr("id", "if(id < 900, 0, 1) as click_day"), {"policy": "a"})
    sinks.write_days(d, str(tmp_path / "d"), rows_per_file=100)
    back = readers.read_days(spark, str(tmp_path / "d"), 0, 1)
    assert back.count() == 1000 and sinks.tags_of(back) == {"policy": "a"}
    assert len([x for x in os.listdir(tmp_path / "d" / "click_day=0") if x.endswith(".parquet")]) >= 9


def test_snapshots_exact(spark):
    found = spark.createDataFrame([("a", c) for c in (15, 30, 45, 59)] + [("b", c) for c in (15, 30, 31, 59, 59)], "run_id string, credit int")
    got = {tuple(r) for r in experiments.verified_snapshots(found, 59).collect()}
    assert got == {("b", 45, "missing"), ("b", 31, "unexpected"), ("b", 59, "repeated")}


def test_selection_results(tmp_path):
    good = {"candidates": [{"config_sha256": "a"}, {"config_sha256": "b"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "a.yaml").write_text("candidates:\n  - config_sha256: a\n  - config_sha256: b\n")
    assert readers.read_selection(str(tmp_path / "a.json")) == readers.read_selection(str(tmp_path / "a.yaml")) == good
    (tmp_path / "b.json").write_text(json.dumps({"candidates": [{"config_sha256": "a"}] * 2}))
    with pytest.raises(ValueError):
        readers.read_selection(str(tmp_path / "b.json"))


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([0.5, 0.25]))
    np.savez(tmp_path / "b.npz", p=np.arange(3), q=np.zeros(0))
    got = sorted((os.path.basename(r.path), r.name, r.i, r.value) for r in readers.read_arrays(spark, str(tmp_path)).collect())
    assert got == [("a.npy", "", 0, 0.5), ("a.npy", "", 1, 0.25), ("b.npz", "p", 0, 0.0), ("b.npz", "p", 1, 1.0), ("b.npz", "p", 2, 2.0)]


def test_training_fixture(spark):
    t = readers.training_fixture(spark)
    assert t.count() == 960 and t.where(is_member(F.col("click_id"), 20260813)).count() == 0
    g = t.groupBy("available_at").agg(F.count("*").alias("n"), F.sum("target").alias("y")).collect()
    assert len(g) == 60 and all(r.n == 16 and r.y == 8 for r in g)
    m = readers.monitoring_fixture(spark, days=3, rows=20)
    assert m.count() == 60 and m.where(~is_member(F.col("click_id"), 20260813)).count() == 0
    assert m.where("click_day = 3").agg(F.sum("final_label")).first()[0] == 20 and m.where("click_day = 1").agg(F.sum("final_label")).first()[0] == 10


def _truth(spark):
    return spark.createDataFrame([("a", 0, 0, 1, 5), ("b", 1, 0, 0, 30), ("c", 2, 1, 1, 9)], "click_id string, click_time long, click_day int, final_label int, available_at long")


def test_sealed_join_refuses(spark):
    t = _truth(spark)
    p = t.select("click_id", F.lit(0.5).alias("probability"))
    assert states.sealed_with_truth(p, t, 30).count() == 3
    for truth, boundary, code in ((t, 29, "IMMATURE_TRUTH"), (t.where("click_id <> 'a'"), 30, "UNKNOWN_CLICKS"), (t.unionByName(t), 30, "REPEATED_TRUTH")):
        with pytest.raises(IntegrityError, match=code):
            states.sealed_with_truth(p, truth, boundary)


def test_cursor_resumes(spark):
    t = _truth(spark)
    c = states.TruthCursor(t)
    assert c.advance(5).count() == 1 and c.advance(5).count() == 0 and c.state() == {"now": 5, "revealed": 1}
    again = states.TruthCursor.resumed(t, c.state())
    assert {r.click_id for r in again.advance(40).collect()} == {"b", "c"}
    with pytest.raises(IntegrityError, match="CURSOR_BACKWARDS"):
        again.advance(39)
    with pytest.raises(IntegrityError, match="CURSOR_MISMATCH"):
        states.TruthCursor.resumed(t.where("click_id <> 'a'"), c.state())


def test_cohort_must_be_mature(spark):
    t = _truth(spark)
    members = t.select("click_id", "click_day")
    assert states.monitoring_cohort(members, states.monitoring_labels(t, members, 30), 2, 1, 2).count() == 3
    with pytest.raises(IntegrityError, match="IMMATURE_COHORT"):
        states.monitoring_cohort(members, states.monitoring_labels(t, members, 29), 2, 1, 2)
    with pytest.raises(IntegrityError, match="TOO_EARLY"):
        states.monitoring_cohort(members, t, 0, 1, 2)
    with pytest.raises(IntegrityError, match="MALFORMED_TRUTH"):
        states.monitoring_labels(t.unionByName(t), members, 30)
    states.check_consecutive([31, 32], 31)
    with pytest.raises(IntegrityError, match="DECISION_GAP"):
        states.check_consecutive([31, 33], 31)


def test_gather_and_parts(spark):
    t = _truth(spark)
    refs = spark.createDataFrame([(0, "c"), (1, "a"), (2, "c")], "position int, click_id string")
    assert [(r.position, r.click_time) for r in states.gathered(t, refs).orderBy("position").collect()] == [(0, 2), (1, 0), (2, 2)]
    with pytest.raises(IntegrityError, match="UNKNOWN_REFERENCE"):
        states.gathered(t.where("click_id = 'a'"), refs)
    assert [r.part for r in states.missing_parts(spark.createDataFrame([(0,), (3,)], "part int")).orderBy("part").collect()] == [1, 2]
    assert states.missing_parts(spark.createDataFrame([], "part int")).count() == 0


def test_empty_ledger(spark):
    got = states.prediction_violations(spark.createDataFrame([], "click_id string, click_day int, probability double"), hex_ids=True).first().asDict()
    assert got == {"bad_probability": 0, "bad_day": 0, "bad_id": 0, "repeated": 0}


def test_replay_is_clean(spark):
    w = scheduling.credit_windows(spark)
    for policy in ("early", "midpoint", "deadline"):
        assert scheduling.replayed_fixed(scheduling.fixed_spends(w, policy), w, policy).count() == 0


def test_run_resumes(spark):
    t = readers.study_a_fixture(spark)
    args = (t, strategies.mature_outcome(t), [31 * DAY, 32 * DAY, 33 * DAY], 2, 0.1)
    whole, first = simulate.run(*args), simulate.run(*args, stop_after=2)
    state = json.loads(json.dumps(first["state"]))
    rest = simulate.run(*args, state=state)
    assert (rest["weight"], rest["bias"], rest["version"], rest["credits"]) == (whole["weight"], whole["bias"], whole["version"], whole["credits"])
    assert sorted(map(tuple, rest["predictions"].collect())) == sorted(map(tuple, whole["predictions"].collect()))
    with pytest.raises(IntegrityError, match="STATE_MISMATCH"):
        simulate.run(*args[:3], 3, 0.1, state=state)


def test_controllers(spark):
    t = readers.study_a_fixture(spark, 95).withColumn("click_day", F.floor(F.col("click_time") / DAY).cast("int"))
    members = t.where(is_member(F.col("click_id"), 20260813)).select("click_id")
    records = strategies.mature_outcome(t)
    out = simulate.final_run(t, members, records, [35, 60], 2, 0.1)
    want = t.where("click_day between 31 and 89")
    assert out["evaluation"].count() == want.count() and out["version"] == 4 and out["start"][0] > 0
    early = out["predictions"].where("click_day < 35").select("model_version").distinct().collect()
    assert [r[0] for r in early] == [0]
    with pytest.raises(ValueError):
        simulate.final_run(t, members, records, [30], 2, 0.1)
    with pytest.raises(IntegrityError, match="EMPTY_COHORT"):
        simulate.initialised(t, t, simulate.Calendar(), 1, 0.1)
    s = simulate.selection_run(t, members, records, 1, 0.1)
    assert s["evaluation"].agg(F.min("click_day"), F.max("click_day"), F.count("*")).first() == (25, 34, 40) and len(s["credits"]) == 10
