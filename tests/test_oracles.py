"""Every query with an oracle against DuckDB on the smallest tables; names and columns agree."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from panelspark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float | np.floating) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = sorted(tuple(norm(r[c]) for c in columns) for r in got.collect())
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert len(found) == len(want)
    close = lambda a, b: a == b or abs(float(a) - float(b)) <= 2e-8
    assert all(x == y or close(x, y) for a, b in zip(found, want, strict=True) for x, y in zip(a, b, strict=True))


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_missing_returns(spark):
    from panelspark.operators import measures, panel

    rows = [(dt.datetime(2020, 1, 1 + i), "a", p) for i, p in enumerate([1.0, None, 2.0, 0.0, 3.0])]
    series = panel.linear_returns(spark.createDataFrame(rows, "t timestamp, asset string, price double"))
    assert [r["r"] for r in series.collect()] == [-1.0]
    assert measures.measure(series.where("false"), ["mean", "cvar"]).count() == 0


def test_portfolio_with_a_missing_return(spark):
    from panelspark.operators.portfolios import portfolio_returns

    series = spark.createDataFrame([("t1", "a", 0.1), ("t1", "b", 0.3), ("t2", "a", 0.2), ("t2", "b", None)], "t string, asset string, r double")
    both = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("q", "a", 1.0), ("q", "b", 0.0)], "portfolio_id string, asset string, weight double")
    got = {(r["portfolio_id"], r["t"]): r["r"] for r in portfolio_returns(series, both).collect()}
    assert got[("p", "t1")] == pytest.approx(0.2) and got[("p", "t2")] is None
    assert got[("q", "t2")] == pytest.approx(0.2)
