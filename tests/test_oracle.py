"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, name, SF)
    assert status in ("ok", "rows-only"), note
    assert rows >= 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["domain", "contacts", "sources"] and out.count() > 0
