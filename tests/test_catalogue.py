import pytest

import __spark_entry__ as entry
from gaugeworks.plans import catalogue

from . import oracle

MAY_BE_EMPTY = {"secret_scan", "consecutive_failures", "benchmark_token_overlap"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert oracle.check(spark, con, sf_dir, catalogue.QUERIES[name], catalogue.SQL[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert {r.l_linestatus for r in entry.entry(spark).collect()} == {"F", "O"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = lambda name: catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(p_brand,Brand#1))" in plan("estimated_cost")
    assert "l_extendedprice" not in plan("ladder_points")
