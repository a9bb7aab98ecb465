"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import TABLES, frame
from tidefolio.checks.oracle import ORACLES
from tidefolio.checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    ours = frame(QUERIES[name](spark, SF).toPandas())
    theirs = frame(db.sql(ORACLES[name]).df())
    assert len(ours) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=True)


def test_entry(spark):
    assert entry.entry(spark).count() == 2133
