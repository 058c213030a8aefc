"""Every query against its DuckDB text on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
import check
from tallyroll.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(entry_points.queries()) and set(QUERIES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note = check.compare(spark, con, FOLDER, name)
    assert good, note
