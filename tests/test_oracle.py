"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from quantloom.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if hasattr(v, "year") and not hasattr(v, "hour") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
