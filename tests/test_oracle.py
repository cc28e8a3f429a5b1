"""Every query with oracle SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from shelfscope import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, str) or hasattr(x, "year"):
            return str(x)
        return round(float(x), 6)

    return sorted(str([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
