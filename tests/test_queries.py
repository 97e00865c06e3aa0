"""Every registered query against its SQL statement, on whole tables."""
import os

import pytest

from __spark_entry__ import entry, queries
from listingflow.registry import ORACLES, QUERIES
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problems, n = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert not problems
    assert n > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
