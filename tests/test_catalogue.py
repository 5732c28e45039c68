import pytest

from skerry.plans import catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_duckdb(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_filter_reaches_the_scan(spark):
    df = catalogue.queries()["knn_prefilter"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(label" in plan and "TakeOrderedAndProject" in plan
