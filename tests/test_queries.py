"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

from airgrid.plans import catalog

SF_DIR = os.environ.get("AIRGRID_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message = oracle.compare(spark, con, name, SF_DIR)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
