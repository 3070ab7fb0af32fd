"""Every query with SQL gives that SQL's rows."""

import numbers

import duckdb
import pandas as pd
import pytest

from lumenseq import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, numbers.Number) else x
    return sorted((tuple(clean(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "lineitem", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), oracle.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
