"""Every core query against its SQL; every query runs."""

import pytest

from lodevec.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tiny, con, name):
    df = registry.QUERIES[name](spark, tiny)
    if name in registry.SQL:
        same(df, registry.SQL[name], con)
    else:
        assert df.count() > 0 and df.columns


def test_entry_without_llm(spark, monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "lodevec.llm", None)
    monkeypatch.setitem(sys.modules, "lodevec.llm.queries", None)
    assert set(e.queries()) == set(registry.QUERIES)
    assert set(e.oracle_sql()) == set(registry.SQL)


def test_plans_push_down_and_prune(spark, tiny):
    from pyspark.sql import functions as F

    from lodevec.operators import search
    from lodevec.sources.tables import table

    m = table(spark, tiny, "manifest").where(F.col("time_ns").between(5, 9)).select("global_id")
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time_ns,5)" in plan and "shard_path" not in plan.split("ReadSchema")[1]
    v = table(spark, tiny, "frame_vectors")
    plan = search.top(v, [1.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "ArrowInPandas" not in plan and "MapInArrow" in plan and "Exchange" not in plan
