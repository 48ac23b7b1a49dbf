"""Every query against its SQL, on the tables."""

import math
import os

import duckdb
import pytest

import marlstone.plans as plans

SIZE = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"create view {n} as select * from '{SIZE}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, list):
        return [plain(x) for x in v]
    if hasattr(v, "normalize"):
        return repr(round(float(v), 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SIZE)
    rel = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(got.columns)
    a = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=str)
    at = [rel.columns.index(c) for c in cols]
    b = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=str)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SIZE).count() > 0
