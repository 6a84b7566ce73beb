"""Every core query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import pytest

from apothecary.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert got == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    compare(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


def test_flagship_has_rows(spark):
    assert registry.queries()[registry.FLAGSHIP](spark, DATA).limit(1).count() == 1
