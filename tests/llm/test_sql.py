"""Every query of the subpackage with SQL gives what its SQL gives, on the smallest tables."""

import os
from pathlib import Path

import pytest

from siftwell.llm import queries
from tests.compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    fine, said = compare(spark, con, FOLDER, name, queries.QUERIES[name], queries.SQL[name])
    assert fine, said
