"""The llm queries with SQL against it, on the smallest tables."""

import pytest

q = pytest.importorskip("lodevec.llm.queries")

from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, tiny, name):
    same(q.QUERIES[name](spark, tiny), q.SQL[name], connect(tiny))
