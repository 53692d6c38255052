"""Every registered query against its checking SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from checks.queries import SQL
from checks.run import rows_by_name
from conftest import SF_SMALL

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF_SMALL)
    answer = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(names, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 7
