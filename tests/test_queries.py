"""Every query with an oracle against DuckDB on the small tables; the rest must give rows."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans import COVERS, ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the supplied tables")
#: On so few rows these give none, or a panel too small to solve.
SPARSE = {"traded_only"}


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    number = type(v).__name__.startswith(("float", "Decimal", "int", "uint"))  # a column with nulls turns into floats
    return round(float(v), 6) + 0.0 if number else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(plain(v) for v in r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SPARSE))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_query_states_what_it_covers():
    assert all(COVERS.values())
