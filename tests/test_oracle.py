"""Every named query against the other engine, on the smallest test tables."""

import glob
import os

import pytest

import __spark_entry__ as driver

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def rows(table):
    columns = sorted(table.column_names)
    found = zip(*(table.column(name).to_pylist() for name in columns))
    return columns, sorted(found, key=repr)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows(spark, other, name):
    ours = driver.queries()[name](spark, FOLDER).toArrow()
    theirs = other.sql(driver.oracle_sql()[name]).to_arrow_table()
    assert rows(ours) == rows(theirs)
    assert ours.num_rows > 0
