import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
#: Queries of the core with SQL, but two that run the whole index run again.
NAMES = sorted(set(registry.ORACLE_SQL) - {"index_counters", "reindex_listed"})


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 9)
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_sql_agrees(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
