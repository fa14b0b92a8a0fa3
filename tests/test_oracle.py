"""Every registered query with a SQL twin gives the same rows on the smallest tables."""

import pytest

import workbook
from compare import check, duck

FOLDER = "/root/testdata/sf0.001"
workbook.load()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(workbook.ORACLES))
def test_matches_sql(spark, connection, name):
    assert check(spark, connection, FOLDER, name) is None


QUICK = ["permutation_importance", "regression_forecast_panel", "ml_forecast_ridge_regression"]


@pytest.mark.parametrize("name", QUICK)
def test_gives_rows(spark, name):
    assert workbook.QUERIES[name](spark, FOLDER).limit(1).count() == 1
