"""Every registered query with a SQL twin equals DuckDB on sf0.001; the
rest run and return rows."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from inkgauge.sources.tables import TABLES

QUERIES = E.queries()
SQLS = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf001, t + '.parquet')}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["metric", "method", "ordinal"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf001, con, name):
    df = QUERIES[name](spark, sf001)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns
    if name not in SQLS:
        assert len(rows) > 0
        return
    rel = con.sql(SQLS[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert _digest(df.columns, rows) == _digest(rel.columns, drows)
