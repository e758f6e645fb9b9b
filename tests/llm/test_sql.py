"""Text queries that SQL can express, beside their SQL; the others are held against plain versions."""

import os

import pytest

from merchframe.llm import queries
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


def test_which_queries_have_sql():
    assert set(queries.ORACLES) == {"op4_line_dedup", "op8_chat_formatting"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_text_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) is None
