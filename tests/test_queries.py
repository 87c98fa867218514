"""Every query with SQL against DuckDB on the smallest tables; the others for a stable schema."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"boosted_fit", "response_bundle", "trajectory", "certificates"}


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return x


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, data, name):
    got = QUERIES[name](spark, data)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_fits_and_features_take_every_row(spark, con, data):
    """All days and detectors, counted by plain SQL from the series with enough readings."""
    series = con.execute("""select city, count(*) as n from utd19_u where day is not null and isfinite("interval") and isfinite(flow) and isfinite(occ) and city is not null and detid is not null
      and coalesce(case when isfinite(error) then error end, 0) = 0 group by city, detid having count(*) >= 100""").fetchall()
    assert series
    assert QUERIES["lag_features_full"](spark, data).count() == QUERIES["calendar_features_full"](spark, data).count() == sum(n for _, n in series)
    train = {}
    for city, n in series:  # six rows without lags come first, one row without a target last
        train[city] = train.get(city, 0) + int(0.6 * n) - 1 - 6
    assert {r.city: r.n for r in QUERIES["linear_fit"](spark, data).collect()} == train
