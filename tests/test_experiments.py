from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from latelens.errors import IntegrityError
from latelens.operators import checks
from latelens.plans import experiments
from latelens.sources import readers

DAY = 86_400


def test_stages_carry_the_winner(spark):
    def score(plans):
        rows = [(p["plan_id"], abs(p["rate"] - 0.1) + (p.get("dropout", 0.0)), 1, 1, "ok") for p in plans]
        return spark.createDataFrame(rows, "plan_id string, loss double, compute_seconds int, parameters int, status string")

    got = experiments.run_stages(spark, [("model", {"rate": [0.01, 0.1, 1.0]}), ("delay", {"dropout": [0.2, 0.1]})], score)
    assert got == {"rate": 0.1, "dropout": 0.1}


def test_matrix(spark):
    m = experiments.final_matrix(spark)
    assert m.where("study <> 'offline'").count() == 33 and m.where("study = 'offline'").count() == 6
    assert experiments.snapshots(59) == [15, 30, 45, 59]


def test_lock(tmp_path):
    p = str(tmp_path / "lock.json")
    experiments.write_lock(p, {"a": 1}, {"data": "x"})
    assert experiments.verified_lock(p, {"data": "x"}) == {"a": 1}
    with pytest.raises(FileExistsError):
        experiments.write_lock(p, {"a": 2}, {"data": "x"})
    with pytest.raises(IntegrityError):
        experiments.verified_lock(p, {"data": "y"})
    d = json.load(open(p))
    d["decisions"]["a"] = 3
    os.unlink(p)
    json.dump(d, open(p, "w"))
    with pytest.raises(IntegrityError):
        experiments.verified_lock(p, {"data": "x"})


def test_rolling_store_falls_back(tmp_path):
    s = experiments.RollingStore(str(tmp_path))
    assert s.load() is None
    for g in range(4):
        s.write(g, {"x": g})
    assert s.load() == (3, {"x": 3})
    (tmp_path / "state-1.json").write_text('{"generation": 9')
    assert s.load() == (2, {"x": 2})


def test_store_checks(spark):
    t = readers.boundary_fixture(spark)
    pos, neg = t.where("final_label = 1"), t.where("final_label = 0")
    assert tuple(checks.truth_part(pos, t, 1, 30 * DAY).first()) == (0, 0, 0, 0)
    assert tuple(checks.truth_part(neg, t, 0, 30 * DAY).first()) == (0, 0, 0, 0)
    bad = neg.withColumn("available_at", F.col("available_at") + 1)
    assert checks.truth_part(bad, t, 0, 30 * DAY).first().wrong_delay == 3
    assert checks.truth_part(neg, t.where("click_id <> 'click-001'"), 1, 30 * DAY).first().unknown_click == 1
    f = spark.createDataFrame([(0, 1.0, True, False, 0, 2, 5), (2, 2.0, True, True, 1, 0, 9)], "click_day int, click_time double, cold_user boolean, cold_product boolean, prior_user_clicks long, prior_product_clicks long, x_bucket int")
    r = checks.feature_store(f, {"x": 8}, 0, 1).first()
    assert (r.cold_user, r.cold_product, r.day_out_of_range, r.x_bucket) == (1, 0, 1, 1)
    assert [x.click_day for x in checks.missing_days(f, 0, 2).collect()] == [1]
    rec = spark.createDataFrame([("a", "FINAL", 1), ("a", "FINAL", 1), ("b", "FINAL", 9)], "click_id string, kind string, available_at long")
    assert tuple(checks.ledger(rec, 5).first()) == (1, 1)
    assert checks.excluded_members(rec, rec.where("click_id = 'b'")).count() == 1
