"""Every query against its SQL twin, on the smallest given tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
from tallyline.catalog import all_queries
from tallyline.oracles import all_oracles

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="given tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query(spark, database, name):
    found = driver.queries()[name](spark, TABLES)
    columns = sorted(found.columns)
    result = database.execute(driver.oracle_sql()[name])
    names = [entry[0] for entry in result.description]
    assert sorted(names) == columns
    at = [names.index(column) for column in columns]
    expected = Counter(tuple(row[n] for n in at) for row in result.fetchall())
    assert Counter(tuple(row) for row in found.select(*columns).collect()) == expected


def test_entry(spark):
    assert driver.entry(spark).columns == ["repo_id", "user_id", "score", "percent"]

