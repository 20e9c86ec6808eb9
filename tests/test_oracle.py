"""Every registered query against its SQL twin on the small tables."""

import pytest

from termloom.catalog.registry import builders, oracles
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(oracles()))
def test_matches_sql(spark, con, name):
    assert compare(builders()[name](spark, SF_DIR), con, oracles()[name]) == []


@pytest.mark.parametrize("name", [n for n in builders() if n not in oracles()])
def test_rows_only(spark, name):
    df = builders()[name](spark, SF_DIR)
    assert df.count() > 0
