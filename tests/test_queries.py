"""Every query with SQL gives what its SQL gives, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from siftwell.plans import catalog
from tests.compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    fine, said = compare(spark, con, FOLDER, name, catalog.QUERIES[name], catalog.SQL[name])
    assert fine, said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
