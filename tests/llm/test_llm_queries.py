"""The text queries run on the smallest tables and give the rows of their SQL where there is one."""

import glob
import os

import pytest
from test_queries import DIR, canonical

from annalist.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, DIR).toPandas()
    if name in queries.SQL:
        want = c.sql(queries.SQL[name]).df()
        assert canonical(got) == canonical(want)
