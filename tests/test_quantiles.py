"""Exact quantiles and calendar folds against numpy on small data with hot values."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtally.functions import quantiles as quantile_module
from prismtally.functions.ordinals import gap_counts, ordinal_regression
from prismtally.functions.quantiles import EXACT_VALUES_KEY, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(params=["0", "500"])
def selection(spark, request):
    """Force the distributed selection instead of the built-in aggregate."""
    spark.conf.set(EXACT_VALUES_KEY, request.param)
    yield
    spark.conf.unset(EXACT_VALUES_KEY)


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(3000):
        group = "hot" if rng.random() < 0.4 else rng.choice("abc")
        x = 7.0 if rng.random() < 0.35 else rng.gauss(0, 1) * 10 ** rng.randint(-3, 9)
        y = None if rng.random() < 0.2 else rng.random()
        rows.append((group, x, y))
    return rows


def test_selection_of_whole_columns(spark, selection):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = quantiles(df, {"x": F.col("x"), "y": F.col("y")}, PROBS).first()
    np.testing.assert_allclose(got["x"], np.quantile([r[1] for r in rows], PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile([r[2] for r in rows if r[2] is not None], PROBS), rtol=1e-12)


def test_selection_per_group(spark, selection):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r["x"] for r in quantiles(df, {"x": F.col("x")}, [0.25, 0.5, 0.75], by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        np.testing.assert_allclose(got[g], np.quantile([r[1] for r in rows if r[0] == g], [0.25, 0.5, 0.75]), rtol=1e-12)


def test_selection_with_frequencies(spark, selection):
    rows = [(1.0, 5), (2.5, 1), (9.0, 4), (100.0, 3)]
    df = spark.createDataFrame(rows, "v double, n int")
    flat = [v for v, n in rows for _ in range(n)]
    got = quantiles(df, {"v": F.col("v")}, PROBS, weight=F.col("n")).first()["v"]
    np.testing.assert_allclose(got, np.quantile(flat, PROBS))


def test_both_ways_agree(spark, selection):
    df = spark.createDataFrame(_rows(3), "g string, x double, y double")
    slow = quantiles(df, {"x": F.col("x")}, PROBS).first()["x"]
    spark.conf.unset(EXACT_VALUES_KEY)
    assert quantiles(df, {"x": F.col("x")}, PROBS).first()["x"] == pytest.approx(slow, rel=1e-12)


def _stamps(seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for _ in range(1500):
        day = 3 if rng.random() < 0.4 else rng.randint(0, 40)
        second = rng.choice([0, 5, rng.randint(0, 86_399)])
        out.append(base + dt.timedelta(days=day, seconds=second, microseconds=rng.choice([0, 0, rng.randint(0, 999_999)])))
    return out


def test_ordinal_regression_equals_numpy(spark):
    stamps = sorted(set(_stamps(4)))
    ys = [1e9 + i * 0.5 + random.Random(i).gauss(0, 20) for i in range(len(stamps))]
    df = spark.createDataFrame(list(zip(stamps, ys)), "ts timestamp_ntz, y double")
    got = ordinal_regression(df).first()
    x = np.arange(len(ys))
    slope, intercept = np.polyfit(x, ys, 1)
    assert got["n"] == len(ys)
    assert got["slope"] == pytest.approx(slope, rel=1e-6)
    assert got["intercept"] == pytest.approx(intercept, rel=1e-9)
    assert got["r"] == pytest.approx(np.corrcoef(x, ys)[0, 1], rel=1e-6)
    assert (got["first_y"], got["last_y"]) == (ys[0], ys[-1])


def test_gap_counts_are_all_gaps(spark):
    stamps = _stamps(5)
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    got = {}
    for r in gap_counts(df, "ts").collect():
        got[round(r["gap_seconds"], 6)] = r["freq"]
    want = {}
    ordered = sorted(stamps)
    for a, b in zip(ordered, ordered[1:]):
        key = round((b - a).total_seconds(), 6)
        want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_folds_do_not_depend_on_the_session_zone(spark, zone):
    """Wall-clock times that a zone skips or repeats are ordinary times here."""
    start = dt.datetime(2024, 3, 10, 0, 0, 0, 250_000)
    stamps = [start + dt.timedelta(minutes=20 * i) for i in range(30)]
    df = spark.createDataFrame([(s, float(i)) for i, s in enumerate(stamps)], "ts timestamp_ntz, y double")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [(r["gap_seconds"], r["freq"]) for r in gap_counts(df, "ts").collect()] == [(1200.0, 29)]
        fit = ordinal_regression(df).first()
        assert fit["slope"] == pytest.approx(1.0) and fit["r"] == pytest.approx(1.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


INFINITE = [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]


def test_infinite_values_are_the_same_at_any_size(spark, selection):
    rows = [("a", v) for v in INFINITE] + [("b", 1.0), ("b", 2.0), ("b", float("inf")), ("b", float("inf"))] + [("c", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    small = {r["g"]: r["x"] for r in quantiles(df, {"x": F.col("x")}, probs, by=["g"], builtin_values=10**9).collect()}
    large = {r["g"]: r["x"] for r in quantiles(df, {"x": F.col("x")}, probs, by=["g"], builtin_values=0).collect()}
    assert small == large
    for g in "abc":
        assert quantiles(df.where(F.col("g") == g), {"x": F.col("x")}, probs).first()["x"] == small[g]
    assert small["b"] == [1.0, 1.75, float("inf"), float("inf"), float("inf")]


def _long_column(spark, n=60_000):
    """Spread over eight partitions: a hot value, wide and narrow spreads, missing values, infinities."""
    rng = np.random.default_rng(11)
    x = np.where(rng.random(n) < 0.35, 7.0, rng.normal(size=n) * 10.0 ** rng.integers(-3, 9, n))
    z = np.where(rng.random(n) < 0.01, np.inf, np.where(rng.random(n) < 0.02, -np.inf, np.round(rng.normal(size=n), 1)))
    rows = list(zip(x.tolist(), [None if v > 2 else float(v) for v in rng.normal(size=n)], z.tolist(), range(n)))
    df = spark.createDataFrame(rows, "x double, y double, z double, k long").repartition(8)
    return rows, df


def test_long_columns_by_sketch_and_one_exact_scan(spark, selection):
    rows, df = _long_column(spark)
    got = quantiles(df, {c: F.col(c) for c in "xyzk"}, PROBS).first()
    for c, values in zip("xyzk", zip(*rows)):
        ranked = sorted(v for v in values if v is not None)
        spots = [p * (len(ranked) - 1) for p in PROBS]
        ends = [(ranked[int(np.floor(s))], ranked[int(np.ceil(s))], s % 1) for s in spots]
        np.testing.assert_allclose(got[c], [a if a == b else a + (b - a) * part for a, b, part in ends], rtol=1e-12)


def test_a_rank_outside_its_bracket_is_still_right(spark, monkeypatch):
    rows, df = _long_column(spark, 20_000)
    monkeypatch.setattr(quantile_module, "SKETCH_MARGIN", 1e-9)
    monkeypatch.setattr(quantile_module, "SKETCH_SIZE", 8)
    got = quantiles(df, {"x": F.col("x"), "k": F.col("k")}, PROBS).first()
    np.testing.assert_allclose(got["x"], np.quantile([r[0] for r in rows], PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["k"], np.quantile([r[3] for r in rows], PROBS), rtol=1e-12)


def test_two_scans_whatever_the_columns(spark):
    _, df = _long_column(spark, 20_000)
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    watched = df.mapInArrow(seen, df.schema)
    quantiles(watched, {c: F.col(c) for c in "xyzk"}, [0.25, 0.5, 0.75]).first()
    assert scans.value == 2 * 20_000


def test_odd_columns(spark):
    df = spark.createDataFrame([(None, 1.0, float("nan")), (None, 1.0, 2.0)], "a double, b double, c double")
    got = quantiles(df, {c: F.col(c) for c in "abc"}, [0.0, 0.5]).first()
    assert got["a"] is None and got["b"] == [1.0, 1.0] and got["c"] == [2.0, float("inf")]
    assert quantiles(df.limit(0), {"b": F.col("b")}, [0.5]).first()["b"] is None
