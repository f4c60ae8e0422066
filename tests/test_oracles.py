"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinetra.plans import registry
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    told = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in told.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).limit(5).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
