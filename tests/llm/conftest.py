from __future__ import annotations

import pytest

from gazette.llm.common import prepare

DOCS = "doc_id bigint, text string, n_tokens string, `class` string, kept string, score string, id string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names the operators use themselves."""
    prepare(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], DOCS)

    return make
