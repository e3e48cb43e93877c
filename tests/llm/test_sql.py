"""Queries of the text operators against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from latelens.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.execute(ORACLE_SQL[name]).fetchdf()
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
