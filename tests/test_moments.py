"""Moments of many columns against plain sums, in one piece and merged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtally.functions import moments
from prismtally.operators.profile import numeric_profile


def columns(n=5000):
    rng = np.random.default_rng(9)
    values = np.column_stack([rng.normal(size=n), rng.exponential(size=n) * 1e6, np.full(n, 0.1), 1e9 + rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.full(n, np.nan)])
    values[rng.random(values.shape) < 0.1] = np.nan
    return values


def plain(x, fence):
    d = x - x.mean() if len(x) else x
    return [len(x), x.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum(), x.min(), x.max(), ((x < fence[0]) | (x > fence[1])).sum()] if len(x) else None


def test_merged_in_any_order():
    values = columns()
    for cuts in ([1, 2, 10], [2500], [4999], [0, 700, 700]):
        parts = [p for p in np.split(values, cuts)]
        for order in (parts, parts[::-1]):
            total = moments.empty(values.shape[1])
            with np.errstate(all="ignore"):
                for p in order:
                    total = moments.merged(total, np.column_stack([moments.of_values(p[~np.isnan(p[:, i]), i], (-1, 1)) for i in range(p.shape[1])]))
            for i in range(values.shape[1] - 1):
                want = plain(values[~np.isnan(values[:, i]), i], (-1, 1))
                np.testing.assert_allclose(total[[0, 1, 5, 6, 7], i], np.array(want)[[0, 1, 5, 6, 7]], rtol=1e-12)
                np.testing.assert_allclose(total[2:5, i], 0 if i == 2 else want[2:5], rtol=1e-6, atol={0: 1e-3, 3: 1, 4: 1e-3}.get(i, 0))
            assert total[0, -1] == 0


def test_one_scan_for_any_number_of_columns(spark):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(4000).select(*[(F.col("id") * (i + 1) % 97).cast("double").alias(f"c{i}") for i in range(40)])
    got = moments.column_moments(df.mapInArrow(watch, df.schema), [F.col(c) for c in df.columns], [None] * 40)
    assert seen.value == 4000 and got[0].tolist() == [4000] * 40


def test_profile_of_odd_columns(spark):
    rows = [(1.0, 2.0, None, 5), (1.0, float("inf"), None, 6), (1.0, 3.0, None, None)]
    got = {r["name"]: r.asDict() for r in numeric_profile(spark.createDataFrame(rows, "a double, b double, c double, d int")).collect()}
    assert got["a"]["std"] == 0 and got["a"]["skewness"] == 0 and got["a"]["kurtosis"] is None
    assert got["b"]["max"] == float("inf") and got["b"]["mean"] == float("inf")
    assert got["c"]["mean"] is None and got["c"]["min"] is None and got["c"]["outlier_pct"] == 0
    assert got["d"]["std"] == pytest.approx(0.7071) and got["d"]["skewness"] is None
