"""Every registered query against its SQL, on the given tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield connection
    connection.close()


def key(row):
    return tuple((value is not None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    result = queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    expected = tables.sql(oracle_sql()[name])
    assert columns == sorted(expected.columns)
    expected_rows = tables.sql(
        f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM expected"
    ).fetchall()
    rows = [tuple(row) for row in result.select(columns).collect()]
    assert len(rows) > 0
    assert sorted(rows, key=key) == sorted(expected_rows, key=key)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
