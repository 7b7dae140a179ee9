"""Tail probabilities and rounding against published table values."""

import pytest
from pyspark.sql import functions as F

from prismtally.functions.rounding import nearest
from prismtally.functions.stats import f_upper, regularized_beta, t_two_sided


@pytest.mark.parametrize(
    "t, dof, p",
    [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1_000_000, 0.05), (0.0, 5, 1.0)],
)
def test_t_table(t, dof, p):
    assert t_two_sided(t, dof) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("f, d1, d2, p", [(4.965, 1, 10, 0.05), (3.708, 3, 10, 0.05), (4.256, 2, 9, 0.05), (2.7, 60, 7, 0.0944)])
def test_f_table(f, d1, d2, p):
    assert f_upper(f, d1, d2) == pytest.approx(p, abs=2e-2 if d1 == 60 else 2e-4)


def test_limits_join_smoothly():
    for f, d1 in ((3.0, 2), (1.2, 7), (0.4, 11), (2.5, 1)):
        assert f_upper(f, d1, 0.9e7) == pytest.approx(f_upper(f, d1, 1.1e7), abs=1e-6)
    assert t_two_sided(2.0, 0.9e7) == pytest.approx(t_two_sided(2.0, 1.1e7), abs=1e-6)
    assert f_upper(3.841, 1, 1e12) == pytest.approx(0.05, abs=1e-4)


def test_beta_edges():
    assert regularized_beta(2, 3, 0) == 0 and regularized_beta(2, 3, 1) == 1
    assert regularized_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert t_two_sided(None, 3) is None and f_upper(1.0, 0, 3) is None


def test_nearest_equals_python(spark):
    values = [k / n * 100 for n in (800, 60000, 7) for k in range(0, n, 3)] + [-0.125, 1e15 + 0.3, 3 / 60000, 9 / 60000, 0.005, -0.004]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", nearest(F.col("v"), 2).alias("two"), nearest(F.col("v"), 4).alias("four")).collect()
    for r in got:
        assert r["two"] == round(r["v"], 2), r
        assert r["four"] == round(r["v"], 4), r
