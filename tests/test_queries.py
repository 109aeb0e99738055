"""Every core query runs on the smallest tables and, where SQL can say it, gives the rows of its SQL."""

import glob
import os

import pytest

from annalist.plans import catalogue

DIR = "/root/testdata/sf0.001"


def canonical(df):
    def cell(v):
        return None if v is None or (isinstance(v, float) and v != v) else repr(v) if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
