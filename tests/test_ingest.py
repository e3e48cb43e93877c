from __future__ import annotations

import tarfile

import pytest
from pyspark.sql import functions as F

from latelens.operators import ingest
from latelens.sources import readers

DAY = 86_400


def raw(spark, rows):
    cols = ["raw_row_index", "Sale", "SalesAmountInEuro", "time_delay_for_conversion", "click_timestamp", "nb_clicks_1week", "product_price", "user_id"]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(f"{c} {'long' if c == 'raw_row_index' else 'string'}" for c in cols)), cols[1:]


def reasons(spark, rows):
    d, fields = raw(spark, rows)
    return [r["reasons"] for r in ingest.reason_codes(d, fields).orderBy("raw_row_index").collect()]


def test_each_reason(spark):
    got = reasons(
        spark,
        [
            ("1", "10", "86400", "100", "3", "19.5", "u"),
            ("0", "-1", "-1", "100", "3", "-1", "u"),
            ("1.0", "-1", "-1", "100", "3", "1", "u"),
            ("0", "x", "-1", "100", "3", "1", "u"),
            ("0", "-1", "-1", "inf", "3", "1", "u"),
            ("0", "-1", "-1", "0", "3", "1", "u"),
            ("0", "-1", "-1", "100", "-2", "1", "u"),
            ("0", "5", "-1", "100", "3", "1", "u"),
            ("0", "-1", "0", "100", "3", "1", "u"),
            ("1", "-3", "-4", "100", "3", "1", "u"),
            ("0", "-1", "-1", "100", "3", " ", "u"),
            (None, "-1", "-1", "100", "3", "1", None),
        ],
    )
    assert got == [
        [], [], ["INVALID_SALE"], ["INVALID_NUMBER"], ["NONFINITE_NUMBER"], ["MISSING_OR_NEGATIVE_CLICK_TIME"], ["INVALID_NEGATIVE_VALUE"],
        ["SALE_AMOUNT_INCONSISTENT"], ["SALE_DELAY_INCONSISTENT"], ["SALE_AMOUNT_INCONSISTENT", "SALE_DELAY_INCONSISTENT"],
        ["INVALID_NUMBER", "EMPTY_FIELD"], ["INVALID_SALE", "EMPTY_FIELD"],
    ]


def test_field_count_stands_alone(spark):
    d, fields = raw(spark, [("x", "x", "x", "x", "x", "x", "x")])
    assert ingest.reason_codes(d, fields, F.lit(3)).first()["reasons"] == ["FIELD_COUNT"]


def test_split_reconciles(spark):
    d, fields = raw(spark, [("1", "1", "1", "100", "3", "1", "u"), ("0", "-1", "0", "100", "3", "1", "u")])
    v = ingest.reason_codes(d, fields)
    a, q = ingest.split_rows(v)
    assert (a.count(), q.count()) == (1, 1)
    p = ingest.profile(v).first()
    assert (p.parsed, p.accepted, p.quarantined, p.positives) == (2, 1, 1, 1)


def test_time_unit(spark):
    assert ingest.inferred_unit(ingest.time_units(100, 100 + 89 * DAY, DAY, spark)) == 1.0
    assert ingest.inferred_unit(ingest.time_units(0, 90 * DAY * 1000, DAY * 1000, spark)) == 1e-3
    with pytest.raises(ValueError, match="AMBIGUOUS"):
        ingest.inferred_unit(ingest.time_units(100, 101, 1, spark))


def test_monotonic_violations_over_partitions(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id")).alias("v")).repartition(7)
    assert ingest.monotonic_violations(d, "id", "v").first()["violations"] == 99


def test_raw_text_from_tar(spark, tmp_path):
    line = lambda i: "\t".join(["0", "-1", "-1", str(100 + i), "3", "19.5", *[f"c{i}"] * 17])
    (tmp_path / "log.tsv").write_text("\n".join([line(0), line(1), "short"]) + "\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "log.tsv", "log.tsv")
    d = readers.tar_member(spark, str(tmp_path / "a.tar.gz"), "log.tsv", str(tmp_path / "out" / "log.tsv"))
    rows = d.orderBy("raw_row_index").collect()
    assert [(r.raw_row_index, r.n_fields) for r in rows] == [(0, 23), (1, 23), (2, 1)]
    v = ingest.reason_codes(d, list(readers.FIELDS), F.col("n_fields"))
    assert [r.reasons for r in v.orderBy("raw_row_index").collect()] == [[], [], ["FIELD_COUNT"]]


def test_unsafe_tar(tmp_path):
    (tmp_path / "x").write_text("x")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        t.add(tmp_path / "x", "../x")
    with pytest.raises(ValueError, match="unsafe"):
        readers.check_tar(str(tmp_path / "b.tar"))


def test_numbers_are_those_that_float_takes(spark):
    texts = ["12d", "3f", "_1", "1_", "1__0", "1_0", "+1.", ".5", "1e5", "1e+05", "1e", ".", "", "nan", "-inf", "Infinity", "0x1", "1 2", " 7 ", "1.5_5", "+-1", "١"]

    def known(t):
        try:
            return repr(float(t))
        except ValueError:
            return None

    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ingest.number(F.col("t")).alias("n")).collect()}
    assert {t: None if n is None else repr(n) for t, n in got.items()} == {t: known(t) if t != "١" else None for t in texts}


def test_failing_fields(spark):
    fields = ["Sale", "SalesAmountInEuro", "time_delay_for_conversion", "click_timestamp", "nb_clicks_1week", "product_price", "device_type"]
    rows = [("1", "2", "3", "4", "5", "6", "d"), ("x", "2d", "3", "4", "5", "6", ""), ("0", "5", "-1", "0", "-2", "6", "d"), ("1", "2", "nan", "4", "5", None, "d")]
    v = ingest.reason_codes(spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)), fields)
    got = [sorted(r.failing_fields) for r in v.orderBy("click_timestamp", "Sale").collect()]
    assert sorted(map(tuple, got)) == sorted([(), ("Sale", "SalesAmountInEuro", "device_type"), ("SalesAmountInEuro", "click_timestamp", "nb_clicks_1week"), ("product_price", "time_delay_for_conversion")])
    hist = {r.field: r.n for r in ingest.field_histogram(v, fields).collect()}
    assert hist == {"Sale": 1, "SalesAmountInEuro": 2, "device_type": 1, "click_timestamp": 1, "nb_clicks_1week": 1, "product_price": 1, "time_delay_for_conversion": 1}
    codes = {r.reason: r.n for r in ingest.reason_histogram(v).collect()}
    assert codes["INVALID_NUMBER"] == 2 and codes["EMPTY_FIELD"] == 2 and codes["NONFINITE_NUMBER"] == 1
