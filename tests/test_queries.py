"""Every registered query against its SQL check on the smallest tables."""

import os

import pytest

import compare
from dossierlens.catalog import CHECKS, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Ten suppliers are too few for these to return rows.
MAY_BE_EMPTY = {"f03_search_suppliers", "l03_page_suppliers", "l03_page_suppliers_after"}


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    found = compare.differences(spark, con, SF_DIR, QUERIES[name], CHECKS[name])
    assert found == "" or (found == "no rows" and name in MAY_BE_EMPTY)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
