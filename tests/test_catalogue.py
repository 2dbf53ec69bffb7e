"""Every query with SQL against that SQL, on the smallest tables."""

import pytest

from millrace import catalogue

SQL = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, same):
    same(catalogue.queries()[name], SQL[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_id", "event_type", "value"]
    assert set(SQL) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    df = catalogue.queries()["filter_between"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
