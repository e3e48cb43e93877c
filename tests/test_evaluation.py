from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latelens.operators import bootstrap, evaluation, features, protocol
from latelens.sources import sinks

Y, P = [0, 1, 0, 1, 1, 0, 0, 1], [0.1, 0.8, 0.4, 0.8, 0.4, 0.1, 0.7, 0.7]


def frame(spark, y=Y, p=P):
    return spark.createDataFrame(list(zip(y, p)), "final_label int, probability double")


def test_ties(spark):
    got = evaluation.ranking_metrics(frame(spark)).first()
    y, p = np.array(Y), np.array(P)
    roc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    ap, before = 0.0, 0
    for t in sorted(set(P), reverse=True):
        tp = int(((p >= t) & (y == 1)).sum())
        ap += (tp - before) / 4 * tp / int((p >= t).sum())
        before = tp
    assert (got.roc_auc, got.pr_auc) == (pytest.approx(roc), pytest.approx(ap))


def test_single_class_is_null(spark):
    d = frame(spark, [1, 1], [0.2, 0.3])
    got = evaluation.ranking_metrics(d).first()
    assert (got.pr_auc, got.roc_auc) == (None, None) and evaluation.calibration_fit(d) is None


def test_calibration_fit_recovers(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.05, 0.95, 4000)
    q = 1 / (1 + np.exp(-(0.3 + 0.7 * np.log(p / (1 - p)))))
    y = (rng.uniform(size=4000) < q).astype(int)
    a, b = evaluation.calibration_fit(frame(spark, y.tolist(), p.tolist()).cache())
    assert abs(a - 0.3) < 0.15 and abs(b - 0.7) < 0.15


def test_reliability_has_all_bins(spark):
    r = evaluation.reliability(frame(spark, [1], [1.0])).orderBy("bin").collect()
    assert [x.n for x in r] == [0] * 9 + [1] and r[0].rate is None


def test_slices_suppress(spark):
    cols = "final_label int, probability double, cold_user boolean, cold_product boolean, prior_user_clicks long, prior_product_clicks long, product_price_bin int, device_type string, click_day int, conversion_delay_days double"
    d = spark.createDataFrame([(1, 0.7, True, False, 0, 3, 2, "a", 65, 1.5), (0, 0.2, False, False, 2, 12, 0, "b", 89, None)], cols)
    s = {(r.dimension, r.value): r for r in evaluation.slices(d, 1, 1).collect()}
    assert s["cold_user", "true"].n == 1 and s["cold_user", "true"].log_loss is not None
    assert s["product_price_bin", "3"].reason == "empty" and s["cold_user", "false"].reason == "insufficient_positives"
    assert s["positive_conversion_delay", "[1,3)"].n == 1 and s["click_day_block", "85-89"].n == 1
    v = evaluation.example_violations(d).first()
    assert tuple(v) == (0, 0, 0, 0)


def test_day_weights():
    w = bootstrap.day_weights(list(range(65, 90)), 7, 2000, 3)
    assert w.shape == (2000, 25) and (w.sum(axis=1) == 25).all()
    with pytest.raises(ValueError):
        bootstrap.day_weights([1, 3], 1, 2000, 3)


def test_compact_bootstrap_equals_explicit(spark):
    rng = np.random.default_rng(5)
    n, days = 300, list(range(65, 90))
    day, y, p = rng.integers(65, 90, n), rng.integers(0, 2, n), rng.uniform(0.01, 0.99, n).round(2)
    d = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(day, y, p)], "click_day int, final_label int, probability double")
    w = bootstrap.day_weights(days, 3, 2000, 9)[:5]
    rows = [(i, days[j], int(w[i, j])) for i in range(5) for j in range(25) if w[i, j]]
    t = spark.createDataFrame(rows, "replicate int, click_day int, weight int")
    got = {r.replicate: r for r in bootstrap.replicate_metrics(bootstrap.day_sums(d, []), t, []).collect()}
    auc = {r.replicate: r for r in bootstrap.replicate_auc(d, t, []).collect()}
    for i in range(5):
        k = w[i][day - 65]
        yy, pp = np.repeat(y, k), np.repeat(p, k)
        assert got[i].log_loss == pytest.approx(np.mean(-(yy * np.log(pp) + (1 - yy) * np.log1p(-pp))), abs=1e-12)
        a, b = pp[yy == 1], pp[yy == 0]
        assert auc[i].roc_auc == pytest.approx(((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()), abs=1e-12)


def test_compare(spark):
    rows = [(s, d, k % 2, 0.65 if k % 2 else 0.35) for s in range(3) for d in range(65, 90) for k in range(4)]
    a = spark.createDataFrame(rows, "seed int, click_day int, final_label int, probability double")
    b = a.withColumn("probability", F.when(F.col("final_label") == 1, 0.8).otherwise(0.2))
    same = bootstrap.compare(a, a, blocks=(3,))
    assert all(r["difference"] == 0 and r["lower"] == r["upper"] == 0 for r in same)
    better = bootstrap.compare(a, b)
    assert all(r["upper"] < 0 if r["metric"] in ("log_loss", "brier") else r["upper"] == 0 for r in better) and bootstrap.scheduler_success(better, 0.0, True)
    assert not bootstrap.scheduler_success(better, 0.0, False)


def test_pareto(spark):
    t = spark.createDataFrame([("a", 0.5, 10), ("b", 0.4, 20), ("c", 0.6, 30), ("d", 0.5, 10)], "method string, log_loss double, total_examples long")
    assert [r.method for r in evaluation.pareto(t).collect()] in (["a", "d", "b"], ["d", "a", "b"])


def test_selection(spark):
    rows = [("s", "x", 0.5, 9, 1, "b", "ok"), ("s", "y", 0.5 + 5e-7, 3, 1, "a", "ok"), ("s", "z", 0.4, 1, 1, "a", "failed"), ("t", "q", 0.1, 1, 1, "a", "infra_failure"), ("t", "r", 0.1, 1, 1, "a", "ok")]
    c = spark.createDataFrame(rows, "stage string, id string, loss double, compute_seconds int, parameters int, digest string, status string")
    assert [r.id for r in protocol.select_candidate(c).collect()] == ["y"]


def test_caps(spark):
    p = protocol.cap_projection(spark.createDataFrame([(10,), (50,), (100,)], "steps_per_credit int"), 0.5, 100.0, 1883, 90_000.0)
    assert protocol.largest_fitting(p).first()[0] == 50


def test_digest_ignores_partitioning(spark):
    d = spark.range(2500).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    x = [protocol.ordered_digest(k, ["id"], "h", 100).first()[0] for k in (d.repartition(3), d.coalesce(1))]
    assert x[0] == x[1] and x[0] != protocol.ordered_digest(d.where("id <> 7"), ["id"], "h", 100).first()[0]


def test_nearest_quantiles(spark):
    d = spark.range(101).select(F.col("id").cast("double").alias("v")).repartition(5)
    assert features.nearest_quantiles(d, F.col("v"), (0.0, 0.01, 0.5, 0.99, 1.0)) == {0.0: 0.0, 0.01: 1.0, 0.5: 50.0, 0.99: 99.0, 1.0: 100.0}


def test_reconcile(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "click_id string, click_time long")
    t = spark.createDataFrame([("a", 1), ("b", 9), ("d", 4), ("a", 1)], "click_id string, click_time long")
    assert tuple(features.reconcile(f, t).first()) == (1, 1, 1, 1)


def test_ledger(spark, tmp_path):
    led = sinks.Ledger(spark, str(tmp_path / "led"), ["click_id"], ["click_time", "click_id"])
    d = spark.createDataFrame([("a", 1), ("b", 2)], "click_id string, click_time long")
    led.append(0, d)
    led.append(0, d)
    with pytest.raises(ValueError):
        led.append(0, d.limit(1))
    with pytest.raises(ValueError):
        led.append(2, d)
    assert led.seal()["rows"] == 2
    led.verify()
    with pytest.raises(ValueError):
        led.append(1, d)


def test_days_store(spark, tmp_path):
    from latelens.sources.readers import read_days

    d = spark.range(100).select("id", (F.col("id") % 10).cast("int").alias("click_day"))
    sinks.write_days(d, str(tmp_path / "s"))
    r = read_days(spark, str(tmp_path / "s"), 3, 4)
    assert r.count() == 20 and "PartitionFilters: [isnotnull(click_day" in r._jdf.queryExecution().toString()
    assert sinks.inventory(spark, str(tmp_path / "s")).where("path like '%.parquet'").count() >= 10


def test_report(spark):
    t = spark.createDataFrame([("<a>", [1, 2])], "name string, xs array<int>")
    assert "&lt;a&gt;" in sinks.render({"t": t}, "html") and "1;2" in sinks.render({"t": t, "u": None}, "text")
    assert '"not_available"' in sinks.render({"u": None}, "json")


def test_ranks_and_quantiles_beyond_a_sample(spark, monkeypatch, tmp_path):
    from latelens.operators import sampling
    from latelens.sources.sinks import Ledger

    n = 2_000_000
    key = (F.col("id") * 7_919 + 13) % n
    spark.range(n, numPartitions=8).select(key.alias("k"), (key % 1000).alias("v")).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    r = sampling.ranked(d, ["k"])
    assert r.where("rank <> k").limit(1).count() == 0 and r.count() == n
    assert features.nearest_quantiles(d, F.col("k"), (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)) == {q: int((n - 1) * q + 0.5) for q in (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)}
    assert features.nearest_quantiles(d, F.col("v"), (0.5,)) == {0.5: 500}
    ledger = Ledger(spark, str(tmp_path / "ledger"), ["k"], ["k"])
    ledger.append(0, d)
    ledger.seal()
    ledger.verify()
    x = protocol.ordered_digest(d, ["k"], "v", 1_000).first()[0]
    assert x == protocol.ordered_digest(d.repartition(5), ["k"], "v", 1_000).first()[0] != protocol.ordered_digest(d.where("k <> 77"), ["k"], "v", 1_000).first()[0]


def test_replicate_auc_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(d), int(y), float(round(p, 2)), float(p)) for s, d, y, p in zip(rng.integers(0, 2, 3000), rng.integers(0, 6, 3000), rng.integers(0, 2, 3000), rng.random(3000))]
    d = spark.createDataFrame(rows, "seed int, click_day int, final_label int, tied double, whole double")
    w = bootstrap.day_weights(list(range(6)), 2, 2000, 1)[:5]
    table = spark.createDataFrame([(i, j, int(w[i, j])) for i in range(5) for j in range(6) if w[i, j]], "replicate int, click_day int, weight int")
    for p in ("tied", "whole"):
        got = {(r.seed, r.replicate): (r.pr_auc, r.roc_auc) for r in bootstrap.replicate_auc(d, table, ["seed"], p).collect()}
        for s in (0, 1):
            for i in range(5):
                x = [(r[3] if p == "tied" else r[4], r[2], w[i, r[1]]) for r in rows if r[0] == s]
                pos, neg = sum(k for _, y, k in x if y), sum(k for _, y, k in x if not y)
                tp = fp = ap = roc = 0
                for v in sorted({v for v, *_ in x}, reverse=True):
                    a, b = sum(k for q, y, k in x if q == v and y), sum(k for q, y, k in x if q == v and not y)
                    roc += b * (tp + a / 2)
                    tp, fp = tp + a, fp + b
                    ap += a * tp / (tp + fp) if a else 0
                assert got[s, i] == pytest.approx((ap / pos, roc / (pos * neg)))


def test_day_weights_by_single_draws():
    w = bootstrap.day_weights(list(range(3, 14)), 3, 2000, 5)
    starts = np.random.default_rng(5).integers(0, 9, size=(2000, 4))
    for i in range(0, 2000, 97):
        days = [s + k for s in starts[i] for k in range(3)][:11]
        assert w[i].tolist() == [days.count(k) for k in range(11)]


def test_comparison_has_all_metrics(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 900)
    rows = [(int(s), int(i % 9), int(y[i]), float(np.clip(0.5 + (0.3 if y[i] else -0.3) * g + 0.2 * rng.normal(), 0.01, 0.99))) for s in range(3) for i in range(300) for g in (1,)]
    a = spark.createDataFrame([(s, d, v, 0.5 + (p - 0.5) * 0.2 + 0.001 * (d - 4)) for s, d, v, p in rows], "seed int, click_day int, final_label int, probability double")
    b = spark.createDataFrame(rows, "seed int, click_day int, final_label int, probability double")
    out = bootstrap.compare(a, b, blocks=(1, 3))
    assert [(r["metric"], r["block_days"]) for r in out] == [(m, k) for k in (1, 3) for m in bootstrap.METRICS]
    assert all(r["lower"] <= r["difference"] <= r["upper"] and sorted(r["by_seed"]) == [0, 1, 2] for r in out)
    for d, k in ((a, 0), (b, 1)):
        m = {r.seed: r for r in bootstrap.seed_metrics(d).collect()}
        assert set(m) == {0, 1, 2} and all(0 <= r.ece <= 1 and 0.5 < r.roc_auc <= 1 for r in m.values())
