"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

from __spark_entry__ import entry
from gazette.registry.catalog import QUERIES, oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(oracles()) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 80


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), con, oracles()[name]) is None
