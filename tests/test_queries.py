"""Every registered query against its SQL on the smallest data."""

import os

import duckdb
import pytest

from spanloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
