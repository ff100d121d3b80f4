"""Every registered query with a SQL counterpart gives the same rows on the small tables."""

import pytest

from halyard.catalog import ORACLES, QUERIES, load_all
from tests.checking import compare, connect, plan

FOLDER = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert compare(df, con, ORACLES[name]) is None


def test_every_query_has_rows_or_sql(spark):
    for name in ("e12_recursive_elimination", "l32_feature_importance", "l13_revenue_forecast"):
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["order_month", "revenue", "order_count", "gross_margin", "average_order_value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
