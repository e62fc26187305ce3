"""Every registered query with oracle SQL must agree with it; the others must return rows."""

import compare
import pytest

from prepwright import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_agrees_with_oracle(spark, con, key):
    assert compare.difference(QUERIES[key](spark, SF), con, ORACLE[key]) is None


@pytest.mark.parametrize("key", ["ml_bayes_interval", "ml_select", "ml_baseline", "ml_train_one", "ev_predictions",
                                 "xai_linear_classes"])
def test_returns_rows(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
