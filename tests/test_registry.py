"""Every registered query against its SQL in DuckDB at the smallest scale; those without SQL must return rows."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pytest

from quarrykit import registry
from tests.conftest import SF

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 8)
    return v


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and all(ORACLE.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert rows
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
