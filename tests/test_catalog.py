"""Every query with an oracle gives the oracle's rows; all others give rows of a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__
from postalloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def plain(frame):
    frame = frame[sorted(frame.columns)]
    for name in frame.columns:
        frame[name] = frame[name].map(lambda v: round(v, 6) if isinstance(v, float) else v)
    return sorted(map(tuple, frame.astype(str).to_numpy().tolist())), list(frame.columns)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_oracle(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, FOLDER).toPandas()) == plain(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_an_oracle(spark, name):
    query = catalog.QUERIES[name]
    first, second = query(spark, FOLDER), query(spark, FOLDER)
    assert first.schema == second.schema and first.count() == second.count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
