"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from plateworks.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(rows, names, cols):
    at = [names.index(c) for c in cols]
    return sorted([norm(r[i]) for i in at] for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got, cols = df.collect(), sorted(df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got or df.columns
        return
    r = duck.sql(sql)
    assert sorted(r.columns) == cols
    assert rows_of(got, df.columns, cols) == rows_of(r.fetchall(), list(r.columns), cols)
