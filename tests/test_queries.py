"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from linkloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    rows = [r.asDict() for r in QUERIES[name](spark, DIR).collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    twin = sorted(repr(sorted((k, plain(v)) for k, v in zip(names, r))) for r in cur.fetchall())
    assert sorted(repr(sorted((k, plain(v)) for k, v in r.items())) for r in rows) == twin
