import pytest

from tickloom.plans import catalogue

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], "/root/testdata/sf0.01") is None


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, "/root/testdata/sf0.001").count() == 19
