"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from foliomark.plans import catalog
from foliomark.plans.oracles import oracles

duckdb = pytest.importorskip("duckdb")
SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cells = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, cells.itertuples(index=False, name=None)))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query(spark, database, name):
    found = contract.queries()[name](spark, str(SMALL)).toPandas()
    wanted = database.execute(contract.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) > 0
    assert rows(found) == rows(wanted)


def test_flagship(spark):
    assert contract.entry(spark).columns[-1] == "markdown"
