from __future__ import annotations

import json

import pytest

from latelens import api, cli
from latelens.errors import ConfigError, DataError
from latelens.plans.config import DataConfig, RunConfig, parsed
from latelens.sources import readers

DAY = 86_400


def log(path, rows):
    path.write_text("\n".join("\t".join([*map(str, r), "3", "19.5", *[f"c{i % 3}"] * 17]) for i, r in enumerate(rows)) + "\n")


def test_inspect_and_prepare(spark, tmp_path):
    log(tmp_path / "raw.tsv", [(1, 10, 86_400, 100), (0, -1, -1, 100 + 44 * DAY), (0, -1, 0, 100 + 40 * DAY), (0, -1, -1, 100 + 89 * DAY), (0, -1, -1, 100 + 89 * DAY)])
    got = api.inspect(spark, DataConfig(str(tmp_path / "raw.tsv")))
    p = got["profile"]
    assert (p["parsed"], p["accepted"], p["quarantined"], p["time_unit"]) == (5, 4, 1, 1.0)
    assert [(r.raw_row_index, r.reasons) for r in got["quarantined"].collect()] == [(2, ["SALE_DELAY_INCONSISTENT"])]
    assert got["order"].first()[0] == 0 and got["columns"].collect()[0]["n_fields"] == 23
    made = api.prepare(spark, got["accepted"], str(tmp_path / "store"), p["time_unit"])
    assert made["rows"] == 4 and not any(made["reconciliation"].values())
    f = spark.read.parquet(str(tmp_path / "store" / "features"))
    assert {r.click_day for r in f.collect()} == {0, 44, 89} and "available_at" not in f.columns and "user_id_bucket" in f.columns
    assert readers.read_truth(spark, str(tmp_path / "store" / "truth"), 0, 200).count() == 4


def test_ambiguous_unit(spark, tmp_path):
    log(tmp_path / "raw.tsv", [(1, 10, 1, 100), (0, -1, -1, 101)])
    with pytest.raises(ValueError, match="AMBIGUOUS"):
        api.inspect(spark, DataConfig(str(tmp_path / "raw.tsv")))


def test_simulate(spark):
    got = api.simulate(readers.boundary_fixture(spark), RunConfig(strategy="mature_outcome", decision_times=(DAY, 2 * DAY)))
    assert got["version"] == 8
    with pytest.raises(DataError):
        api.simulate(readers.boundary_fixture(spark), RunConfig(strategy="x"))


def test_configs():
    assert parsed(DataConfig, {"path": "x"}).separator == "\t"
    for bad in ({}, {"path": "x", "y": 1}, {"path": 1}, {"path": "x", "min_span_days": True}, [1]):
        with pytest.raises(ConfigError):
            parsed(DataConfig, bad)


def test_evaluate_and_compare_from_files(spark, tmp_path, capsys):
    def written(name, hi, lo):
        rows = [{"click_id": f"{d}-{k}", "click_day": d, "final_label": k % 2, "probability": hi if k % 2 else lo, "cold_user": True, "cold_product": False, "prior_user_clicks": 0, "prior_product_clicks": 3, "product_price_bin": k, "device_type": "a", "conversion_delay_days": 1.5 if k % 2 else None} for d in range(65, 90) for k in range(4)]
        d = tmp_path / name
        d.mkdir()
        for s in range(3):
            (d / f"{s}.json").write_text(json.dumps({"method": name, "seed": s, "ranking_eligible": True, "sealed": True, "examples": rows}))
        return str(d)

    a, b = written("control", 0.65, 0.35), written("candidate", 0.8, 0.2)
    assert cli.main(["evaluate", a]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["metrics"][0]["n"] == 300 and out["ranking"][0]["roc_auc"] == 1
    assert cli.main(["compare", a, b]) == 0
    rows = json.loads(capsys.readouterr().out)
    assert len(rows) == 12 and all(r["upper"] < 0 for r in rows if r["metric"] in ("log_loss", "brier"))
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["inspect", str(tmp_path / "bad.json")]) == 2
