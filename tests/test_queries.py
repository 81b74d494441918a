"""Every query that has SQL gives that SQL's rows on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronofold import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    got = queries.queries()[name](spark, SF).toPandas()
    expect = tables.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expect.columns)
    got, expect = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expect))
    assert len(got) == len(expect)
    for c in columns:
        assert (got[c] == expect[c].astype(got[c].dtype)).all(), c


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_nested_loop_join(spark):
    for name in ("dedisperse_multi", "fold_cube", "downsample_long"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
