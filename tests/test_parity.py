"""Every query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

from blocklens.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


def canonical(row):
    out = []
    for v in row:
        if isinstance(v, float):
            v = None if math.isnan(v) else round(v, 9)
        out.append((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v))
    return tuple(out)


def key(row):
    return repr(row)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    con = duck.execute(SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(found.columns) == sorted(names)
    want = sorted((canonical(r) for r in con.fetchall()), key=key)
    got = sorted((canonical(tuple(r)) for r in found.select(*(f"`{n}`" for n in names)).collect()), key=key)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
