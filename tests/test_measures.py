"""Business measures on literal tables."""

import datetime as dt

import pytest

from prismtally.operators.measures import evaluate_measure, evaluate_sum_measures


def value(df, **definition):
    return evaluate_measure(df, definition).first()["value"]


def dated(spark, rows):
    return spark.createDataFrame([(dt.datetime(2026, m, d), v) for m, d, v in rows], "date timestamp_ntz, revenue long")


def test_ratio(spark):
    df = spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "sales long, orders long")
    assert value(df, type="ratio", numerator="sales", denominator="orders") == 10


def test_margin(spark):
    df = spark.createDataFrame([(100, 60), (200, 120)], "revenue long, cost long")
    assert value(df, type="margin", revenue="revenue", cost="cost") == 40


def test_period_change(spark):
    df = dated(spark, [(1, 3, 60), (1, 20, 40), (2, 1, 100), (2, 28, 50)])
    assert value(df, type="period_change", metric="revenue", date_column="date", grain="M") == 50


def test_growth_groups_equal_dates(spark):
    df = dated(spark, [(1, 1, 60), (1, 1, 40), (1, 2, 100), (1, 2, 50)])
    assert value(df, type="growth_pct", metric="revenue", date_column="date") == 50


def test_rolling_average(spark):
    df = dated(spark, [(1, 1, 5), (1, 1, 5), (1, 2, 10), (1, 2, 10), (1, 3, 20), (1, 3, 10)])
    assert value(df, type="rolling_average", metric="revenue", date_column="date", window=2) == 25


def test_text_numbers_and_zero_denominators(spark):
    df = spark.createDataFrame([("10", 0), ("x", 0), (None, 0)], "a string, b int")
    assert value(df, type="ratio", numerator="a", denominator="b") is None
    assert value(df, type="conversion_rate", converted="b", total="a") == 0


def test_groups_and_many_measures(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 1, 2), ("y", 3, 4)], "g string, a int, b int")
    defs = [{"name": "r", "type": "ratio", "numerator": "a", "denominator": "b"}, {"name": "m", "type": "margin", "revenue": "b", "cost": "a"}]
    rows = {r["g"]: (r["r"], r["m"]) for r in evaluate_sum_measures(df, defs, by=["g"]).collect()}
    assert rows == {"x": (0.5, 50.0), "y": (0.75, 25.0)}


def test_errors(spark):
    df = dated(spark, [(1, 1, 5)])
    with pytest.raises(ValueError, match="not in the dataset"):
        evaluate_measure(df, {"type": "ratio", "numerator": "nope", "denominator": "revenue"})
    with pytest.raises(ValueError, match="none of the measures"):
        evaluate_measure(df, {"type": "magic"})
    with pytest.raises(ValueError, match="M, Q or Y"):
        evaluate_measure(df, {"type": "period_change", "metric": "revenue", "date_column": "date", "grain": "W"})
    with pytest.raises(ValueError, match="two"):
        evaluate_measure(df, {"type": "growth_pct", "metric": "revenue", "date_column": "date"}, strict=True)
    assert value(df, type="growth_pct", metric="revenue", date_column="date") is None
