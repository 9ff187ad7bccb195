"""Registered queries against the SQL that states the same results, on the smallest tables."""

import os

import pytest

from corpusweave.llm import queries
from test_catalogue import FOLDER, compare


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries)


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)
