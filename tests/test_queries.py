"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from smilegrid.plans import more_queries, panel_queries, portfolio_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v) + 0:.8g}"
    return str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    cursor = duck.execute(queries.SQL[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    assert got == sorted(tuple(plain(r[have.index(c)]) for c in names) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_dense_grid_reads_every_user(spark):
    grid = {(r.day, r.event_type): r for r in queries.QUERIES["dense_grid_all"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("to_date(ts) AS day", "event_type", "value").collect()
    best = {}
    for r in rows:
        best[r.day, r.event_type] = max(r.value, best.get((r.day, r.event_type), r.value))
    assert {k: r.v for k, r in grid.items() if not r.is_missing} == best
    assert all(grid[day, "refund"].is_missing for day, _ in best)
