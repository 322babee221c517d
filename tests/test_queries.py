"""Every registered query with SQL gives the SQL's rows; every other one runs."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry
from inclina.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
# fits of many models: run by ``python tests/oracle.py`` rather than with every test run
SLOW = {
    "leaderboard", "balanced_leaderboard", "product_leaderboards", "recursive_elimination", "elimination_importance", "genetic_search",
    "adaboost", "product_models", "group_models", "tuned_forest", "stacked_scores", "customer_recipe", "monthly_scores",
    "model_grid", "grid_resamples", "stack_weights", "monthly_leaderboards", "daily_scores",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, FOLDER).collect()) > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["NO_CREDITO", "id_cliente"]


def test_entry_lists_the_catalog():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE.items() <= entry.oracle_sql().items()
