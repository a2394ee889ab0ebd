import pytest

import __spark_entry__ as driver
from tests.check import differences


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    df = driver.queries()[name](spark, sf_dir)
    assert differences(df, sf_dir, driver.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
