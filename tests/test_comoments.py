"""Pairwise correlations against numpy on columns with missing, constant, shifted and infinite values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtally.functions.comoments import CoMoments, co_moments
from prismtally.operators import charts
from prismtally.operators.charts import correlation_matrix


def plain(values):
    """``{(i, j): (r, n)}``; r is None where one of the two does not vary over the shared rows."""
    out = {}
    for i, j in itertools.combinations(range(values.shape[1]), 2):
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        a, b = values[both, i], values[both, j]
        if not len(a) or np.ptp(a) == 0 or np.ptp(b) == 0:
            out[i, j] = (None, int(both.sum()))
        elif not (np.isfinite(a).all() and np.isfinite(b).all()):
            out[i, j] = (math.nan, int(both.sum()))
        else:
            out[i, j] = (np.corrcoef(a, b)[0, 1], int(both.sum()))
    return out


def columns(n=4000):
    rng = np.random.default_rng(3)
    base = rng.normal(size=n)
    values = np.column_stack([
        base, 2 * base + rng.normal(size=n), 1e9 + base, np.full(n, 0.1), rng.normal(size=n) * 1e-6, np.where(base > 0, np.nan, 3.3), rng.normal(size=n) ** 3, np.full(n, np.nan),
    ])
    values[rng.random(values.shape) < 0.1] = np.nan
    # Constant wherever column 5 is present, but not elsewhere.
    values[:, 6] = np.where(~np.isnan(values[:, 5]), 123456.789, values[:, 6])
    return values


def compare(found, want, names):
    got = {(names.index(r["left"]), names.index(r["right"])): (r["r"], r["n"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for pair, (r, n) in want.items():
        assert got[pair][1] == n, pair
        if r is None:
            assert got[pair][0] is None, (pair, got[pair])
        elif math.isnan(r):
            assert math.isnan(got[pair][0])
        else:
            assert got[pair][0] == pytest.approx(r, abs=1e-6 if 2 in pair else 1e-10), pair


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_numpy(spark, partitions):
    values = columns()
    names = [f"c{i}" for i in range(values.shape[1])]
    rows = [tuple(None if math.isnan(v) else float(v) for v in row) for row in values]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(partitions)
    compare(correlation_matrix(df), plain(values), names)


def test_partial_results_merge_in_any_order():
    values = columns(999)
    whole = CoMoments.of(values)
    for cuts in ([1, 2, 3], [500], [998], [0, 0, 400]):
        parts = [CoMoments.of(p) for p in np.split(values, cuts) if len(p)]
        for order in (parts, parts[::-1]):
            total = CoMoments.empty(values.shape[1])
            for p in order:
                total.add(p)
            np.testing.assert_allclose(total.n, whole.n)
            np.testing.assert_allclose(total.square, whole.square, rtol=1e-6, atol=1e-9)


def test_infinities_stay_in_their_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 3.0, float("inf")), (3.0, 5.0, 2.0), (4.0, 4.0, None)], "a double, b double, c double")
    got = {(r["left"], r["right"]): (r["r"], r["n"]) for r in correlation_matrix(df).collect()}
    assert got["a", "b"][0] == pytest.approx(0.8) and math.isnan(got["a", "c"][0]) and got["b", "c"][1] == 3


def test_many_columns_are_one_plan(spark):
    wide = spark.range(3000).select(*[(F.sin(F.col("id") * (i + 1)) + F.col("id") * (i % 3)).alias(f"c{i}") for i in range(60)])
    found = correlation_matrix(wide).collect()
    assert len(found) == 60 * 59 // 2 and all(r["n"] == 3000 for r in found)
    values = np.array(wide.collect())
    got = {(r["left"], r["right"]): r["r"] for r in found}
    assert got["c1", "c58"] == pytest.approx(np.corrcoef(values[:, 1], values[:, 58])[0, 1], abs=1e-9)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in correlation_matrix(empty).collect()] == [("a", "b", None, 0)]
    assert correlation_matrix(empty.select("a")).count() == 0 and len(co_moments(empty, []).n) == 0


def test_a_heatmap_too_wide_for_a_table_says_so(spark, monkeypatch):
    df = spark.range(30).select(F.col("id").cast("string").alias("x"), F.lit("a").alias("y"))
    assert len(charts.heatmap(df, "x", "y").columns) == 31
    monkeypatch.setattr(charts, "HEATMAP_COLUMNS", 29)
    with pytest.raises(ValueError, match="heatmap_long"):
        charts.heatmap(df, "x", "y")
    assert charts.heatmap_long(df, "x", "y").count() == 30


def test_figures_of_the_driver_need_no_workers(spark):
    rows = [(float(i), float(i * i % 7), None if i % 3 else float(i), 1.0) for i in range(40)]
    found = correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"))
    # A list would be dealt over all cores, each with a worker that unpickles its share.
    assert found.rdd.getNumPartitions() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    got = {(r["left"], r["right"]): (r["r"], r["n"]) for r in found.collect()}
    assert len(got) == 6 and got["a", "d"] == (None, 40) and got["a", "c"][0] == pytest.approx(1.0) and got["a", "c"][1] == 14
