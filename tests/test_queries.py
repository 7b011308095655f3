"""Registered queries against DuckDB on the smallest tables, and the driver's entry points."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumastack.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows in an order that small differences of numbers hardly change."""
    found = [tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(found, key=lambda r: [[f"{v:.{digits}e}" if isinstance(v, float) else v for v in r] for digits in (4, 12)])


def same(got: list[tuple], want: list[tuple]) -> bool:
    def near(a, b):
        return abs(a - b) <= 1e-9 + 1e-6 * abs(b) if isinstance(a, float) and isinstance(b, float) else a == b

    return len(got) == len(want) and all(near(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(rows(got), rows(want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    found = entry.entry(spark).collect()
    assert 0 < len(found) <= 3
    times = sorted(r["center_ts"] for r in found)
    assert all((b - a).total_seconds() >= 240 * 60 for a, b in zip(times, times[1:], strict=False))


def test_entry_lists_own_queries():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
