"""Every query key against its DuckDB twin (sf0.001), order-insensitive."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from data_dirs import SF1
from vecsight.sources.tables import TABLES

SQL = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF1}/{t}.parquet'")
    return c


def test_every_key_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF1)
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(SQL[key])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(srows, df.columns) == _rows(rel.fetchall(), dcols)


@pytest.mark.parametrize("key", sorted(set(E.queries()) - set(SQL)))
def test_rows_only_keys_run(spark, key):
    assert E.queries()[key](spark, SF1).count() > 0
