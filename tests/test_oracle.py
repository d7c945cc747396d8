import pytest

from attestor.plans import registry

from .compare import SF, assert_same, duck

con = duck()
SLOW = {"kernel_ssim", "kernel_contour", "kernel_gabor", "calibrated_prior"}  # their operators have tests of their own


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
