import os

import pytest

import __spark_entry__ as entry
import compare
from lexispark import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return compare.views(DATA)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), db.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)
