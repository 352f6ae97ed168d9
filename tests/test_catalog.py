"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from quire import catalog
from tests.conftest import DATA


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v if isinstance(v, (int, bool)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    frame = duck.execute(catalog.SQL[name])
    names = [x[0] for x in frame.description]
    assert got == rows(names, frame.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
