"""Every named query against its SQL twin, over the whole smallest tables."""

import os

import pytest

import __spark_entry__ as contract
import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    text, _, _ = compare.check(spark, con, name, SF_DIR)
    assert text.startswith(("ok", "rows-only")), text


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_no_oracle_without_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
