"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, tidy
from tests.conftest import SMALL


# Too few hours at the smallest scale to train on.
NEEDS_MORE = dict.fromkeys(("model_roundtrip", "shapley_identity"), "/root/testdata/sf0.01")


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    sf_dir = NEEDS_MORE.get(name, SMALL)
    got = tidy(entry.queries()[name](spark, sf_dir).toPandas())
    want = tidy(connect(sf_dir).execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
