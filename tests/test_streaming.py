from __future__ import annotations

from pyspark.sql import functions as F

from latelens.operators import strategies
from latelens.streaming import events

DAY = 86_400


def stored(spark, path, rows):
    d = spark.createDataFrame(rows, "kind string, click_id string, t double").select("kind", "click_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("time"))
    d.write.mode("append").parquet(str(path))
    return d.schema


def test_fixed_wait_equals_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows = [("click", "a", 0.0), ("conversion", "a", float(DAY)), ("click", "b", DAY / 2), ("conversion", "b", 1.6 * DAY), ("click", "c", float(DAY))]
    schema = stored(spark, src, rows)
    for later in ([("click", "z", 10.0 * DAY)], [("click", "y", 45.0 * DAY)], [("click", "x", 46.0 * DAY)]):
        d = events.fixed_wait(spark.readStream.schema(schema).parquet(src), DAY, 30 * DAY)
        events.append_to(d, out, ck).awaitTermination()
        stored(spark, src, later)
    d = events.fixed_wait(spark.readStream.schema(schema).parquet(src), DAY, 30 * DAY)
    events.append_to(d, out, ck).awaitTermination()
    got = {(r.click_id, r.kind, r.available_at.timestamp()) for r in spark.read.parquet(out).where("click_id in ('a', 'b', 'c')").collect()}
    t = spark.createDataFrame([("a", 0, 1, DAY), ("b", DAY // 2, 1, int(1.6 * DAY)), ("c", DAY, 0, 31 * DAY)], "click_id string, click_time long, final_label int, available_at long")
    want = {(r.click_id, r.kind, float(r.available_at)) for r in strategies.fixed_wait(t, DAY).collect()}
    import datetime as dt

    shift = dt.datetime(2020, 1, 1).timestamp() - dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    assert {(a, b, c - shift) for a, b, c in got} == want


def test_stateless_twin(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = stored(spark, src, [("click", "a", 0.0), ("conversion", "a", 50.0)])
    events.append_to(events.immediate_fake_negative(spark.readStream.schema(schema).parquet(src)), out, ck).awaitTermination()
    assert {(r.kind, r.target) for r in spark.read.parquet(out).collect()} == {("PROVISIONAL", 0.0), ("CORRECTION", 1.0)}


def test_late_events_and_orphans_go_aside(spark, tmp_path):
    src, out, side, ck = (str(tmp_path / x) for x in ("src", "out", "side", "ck"))
    batches = [
        [("click", "a", 1.0 * DAY), ("conversion", "lost", 2.0 * DAY)], [("click", "z", 80.0 * DAY)],
        [("click", "b", 79.0 * DAY), ("conversion", "a", 5.0 * DAY), ("click", "y", 81.0 * DAY)], [("click", "x", 140.0 * DAY)], [("click", "w", 200.0 * DAY)],
    ]
    for rows in batches:
        schema = stored(spark, src, rows)
        d = events.fixed_wait(spark.readStream.schema(schema).parquet(src), DAY, 30 * DAY)
        events.append_to(d, out, ck, side).awaitTermination()
    read = lambda p: sorted((r.click_id, r.kind) for r in spark.read.parquet(p).collect())
    # b is a day behind, less than Spark's own watermark; the conversion of a is further behind, and a's state has gone
    assert ("b", "LATE") in read(side) and ("lost", "ORPHAN") in read(side) and {k for _, k in read(side)} == {"LATE", "ORPHAN"}
    assert ("a", "PROVISIONAL") in read(out) and ("z", "PROVISIONAL") in read(out) and not {k for _, k in read(out)} & set(events.SIDE)
    assert not [x for x in read(out) if x[0] in ("b", "lost")]


def test_complete_wait_equals_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for rows in ([("click", "a", 1.0 * DAY), ("conversion", "a", 3.0 * DAY), ("click", "b", 2.0 * DAY), ("conversion", "b", 12.5 * DAY)], [("click", "z", 40.0 * DAY), ("conversion", "z", 40.5 * DAY)], [("click", "y", 80.0 * DAY), ("conversion", "y", 80.5 * DAY)]):
        schema = stored(spark, src, rows)
        s = spark.readStream.schema(schema).parquet(src)
        c = s.where("kind = 'click'").select("click_id", F.col("time").alias("click_time"))
        v = s.where("kind = 'conversion'").select("click_id", F.col("time").alias("conversion_time"))
        events.append_to(events.complete_wait(c, v, 10 * DAY), out, ck).awaitTermination()
    got = {(r.click_id, r.kind, r.target) for r in spark.read.parquet(out).where("click_id in ('a', 'b')").collect()}
    assert got == {("a", "FINAL", 1.0), ("b", "FINAL", 0.0)}


def test_tick_counts_of_a_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for rows in ([("click", "a", 4_000.0), ("click", "b", 5_000.0), ("conversion", "a", 7_500.0)], [("click", "z", 50_000.0)], [("click", "y", 90_000.0)]):
        schema = stored(spark, src, rows)
        events.append_to(events.tick_counts(spark.readStream.schema(schema).parquet(src)), out, ck).awaitTermination()
    got = {(r.tick.hour, r.kind, r.n) for r in spark.read.parquet(out).collect()}
    assert {(1, "click", 2), (2, "conversion", 1)} <= got
