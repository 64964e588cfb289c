"""Registered queries against their SQL, and that each is registered."""

from __future__ import annotations

import os
import re

import oracle
import pytest

from __spark_entry__ import oracle_sql, queries
from gazette.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_operators_and_the_pipeline():
    numbers = sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), ORACLES[name]) is None
