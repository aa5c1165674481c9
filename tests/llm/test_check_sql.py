"""Queries with check SQL must give the same rows as DuckDB."""

import pytest
from compare import compare, connect

from sparktab.llm import queries


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_same_rows(spark, sf, key):
    difference = compare(queries.QUERIES[key](spark, sf), connect(sf), queries.ORACLES[key])
    assert difference is None, difference


def test_every_check_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
