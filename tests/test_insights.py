"""Detectors on literal tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismtally.functions import forest, quantiles
from prismtally.operators.insights import drivers, foundational, journeys, segments, series
from prismtally.plans import summary


def months(n, start=2024):
    return [dt.datetime(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_funnel_names_the_weakest_step(spark):
    df = spark.createDataFrame([(1000, 100, 80), (1200, 110, 90)], "visits long, signups long, purchase long")
    (row,) = rows_of(journeys.funnel_insights(df, ["visits", "signups", "purchase"]))
    assert "signups" in row["title"] and row["chart_columns"] == ["visits", "signups"]
    assert row["stat"] == "9.55% conversion" and row["sample_size"] == 2580


def test_funnel_needs_two_stages(spark):
    df = spark.createDataFrame([(1, 2)], "visits long, revenue long")
    assert rows_of(journeys.funnel_insights(df, ["visits", "revenue"])) == []


def test_variance_names_the_moving_segment(spark):
    rows = []
    for month in (1, 2):
        for day in range(1, 5):
            rows.append((dt.datetime(2026, month, day), "A", 100 + 50 * (month == 2)))
            rows.append((dt.datetime(2026, month, day), "B", 80))
    df = spark.createDataFrame(rows, "date timestamp_ntz, segment string, revenue long")
    (row,) = rows_of(series.variance_insights(df, ["date"], ["segment"], ["revenue"]))
    assert row["detail"].startswith("In A it moved by 200.00") and row["stat"] == "2026-02 vs 2026-01"
    assert row["sample_size"] == 8


def test_cohorts(spark):
    rows = [(dt.datetime(2026, 1, 1 + i), f"c{i}") for i in range(10)]
    rows += [(dt.datetime(2026, 2, 1 + i), f"c{i}") for i in range(6)] + [(dt.datetime(2026, 2, 20), f"n{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, customer_id string")
    (row,) = rows_of(journeys.retention_insights(df, ["date"], ["customer_id"]))
    assert row["title"].startswith("2026-01 cohort") and row["stat"] == "60.00% repeat rate"
    assert row["confidence_label"] in {"high", "medium", "low"}


def test_cohorts_ignore_missing_ids_and_need_rows(spark):
    rows = [(dt.datetime(2026, 1, 1 + i), None) for i in range(20)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, customer_id string")
    assert rows_of(journeys.retention_insights(df, ["date"], ["customer_id"])) == []


def test_segment_driver_has_p_value(spark):
    rows = [("A", 100 + i) for i in range(12)] + [("B", 50 + i) for i in range(12)] + [("C", 10 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "segment string, revenue long")
    (row,) = rows_of(segments.segment_driver_insights(df, ["segment"], ["revenue"]))
    assert row["p_value"] == 0.0 and row["confidence_score"] >= 60 and row["stat"] == "A vs C"


def test_segment_driver_with_constant_groups(spark):
    """No variation within the segments: F is unbounded and p is not known to be large."""
    rows = [("A", 1.0)] * 15 + [("B", 3.0)] * 15
    df = spark.createDataFrame(rows, "segment string, v double")
    (row,) = rows_of(segments.segment_driver_insights(df, ["segment"], ["v"]))
    assert row["effect_size"] == 1.0


def test_anomaly(spark):
    values = [100, 102, 98, 101, 99, 103, 97, 100, 101, 99, 102, 450]
    df = spark.createDataFrame([(v,) for v in values], "revenue long")
    (row,) = rows_of(segments.anomaly_insights(df, ["revenue"]))
    assert row["stat"].startswith("1 outliers") and "450.00" in row["detail"]


def test_contribution(spark):
    rows = [("N", 90.0)] * 6 + [("S", 10.0)] * 6
    df = spark.createDataFrame(rows, "region string, sales double")
    (row,) = rows_of(segments.contribution_insights(df, ["region"], ["sales"]))
    assert row["title"] == "N dominates contribution to sales" and row["stat"] == "90.00% share"


def test_forecast(spark):
    df = spark.createDataFrame([(m, 100 + 10 * i) for i, m in enumerate(months(12))], "date timestamp_ntz, revenue long")
    (row,) = rows_of(series.forecast_insights(df, ["date"], ["revenue"]))
    assert "projected to grow" in row["title"] and row["stat"] == "next period 220.00 (+4.8%)"


def test_decomposition(spark):
    rows = [(m, 100 + i * 5 + (40 if m.month in (6, 12) else 0)) for i, m in enumerate(months(18))]
    df = spark.createDataFrame(rows, "date timestamp_ntz, revenue long")
    (row,) = rows_of(series.decomposition_insights(df, ["date"], ["revenue"]))
    assert "seasonal range" in row["stat"]


def test_seasonality(spark):
    rows = [(m, 200 if m.month == 12 else 100) for m in months(36)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, revenue long")
    (row,) = rows_of(series.seasonality_insights(df, ["date"], ["revenue"]))
    assert row["stat"].startswith("month 12 vs month") and row["score"] == 100.0


def test_correlation_distribution_concentration_trend(spark):
    rows = [(dt.datetime(2026, 1, 1 + i), i, 2.0 * i + (i % 3), "x" if i % 4 else "y", float(10**(i // 5))) for i in range(25)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, a long, b double, c string, tail double")
    titles = {r["title"] for r in rows_of(foundational.foundational(df))}
    assert "a and b move together" in titles
    assert "tail has a right-skewed distribution" in titles
    assert "c is concentrated in 'x'" in titles
    assert any(t.endswith("changes over time") for t in titles)


def test_model_driver(spark):
    rows = []
    for i in range(60):
        region = "NSE"[i % 3]
        spend = 100 + i * 3
        rows.append((region, spend, spend * 4 + {"N": 120, "S": 30, "E": 0}[region]))
    df = spark.createDataFrame(rows, "region string, ad_spend long, revenue long")
    (row,) = rows_of(drivers.model_driver_insights(df, ["region"], ["revenue", "ad_spend"], trees=20))
    assert row["kind"] == "model_driver" and row["confidence_score"] >= 60


def test_model_driver_fills_gaps_and_respects_gates(spark):
    rows = [(None if i % 5 == 0 else "ab"[i % 2], None if i % 7 == 0 else float(i), float(i * 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    importance, r2, n = drivers.driver_models(df, ["y"], ["g"], ["x", "y"], trees=10)["y"]
    assert n == 60 and r2 > 0.5 and importance["x"] > importance["g"]
    assert drivers.driver_models(df.limit(10), ["y"], ["g"], ["x", "y"], trees=2) == {}


def test_forests_of_all_measures_are_one_set_of_jobs(spark):
    base = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), *[(F.col("id") * (k + 2) % 101 + k).cast("double").alias(f"m{k}") for k in range(6)],
        F.when(F.col("id") % 5 != 0, F.col("id") * 2.0).alias("gaps"),
    )
    jobs = []
    for count in (2, 6):
        spark.sparkContext.setJobGroup(f"forest{count}", "")
        names = [f"m{k}" for k in range(count)]
        drivers.driver_models(base, names, ["g"], names, trees=3)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest{count}")))
    spark.sparkContext.setJobGroup("tests", "")
    assert jobs[0] == jobs[1] > 0
    again = [drivers.driver_models(base.repartition(p), ["gaps"], ["g"], ["gaps", "m1"], trees=4)["gaps"] for p in (1, 5)]
    assert again[0][2] == 320 and again[0][0] == pytest.approx(again[1][0]) and again[0][1] == pytest.approx(again[1][1])


def test_a_tree_is_what_a_plain_search_grows():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 5, 60), rng.integers(0, 2, 60), rng.integers(0, 9, 60)]).astype(np.uint8)
    y = x[:, 0] * 3.0 + (x[:, 2] > 4) * 7 + rng.normal(size=60)
    drawn = np.bincount(rng.integers(0, 60, 60), minlength=60)
    gains, plain = np.zeros(3), np.zeros(60)

    def grow(rows):
        w = drawn[rows]
        best = (0.0, None, None)
        base = (w @ y[rows]) ** 2 / w.sum()
        for f in range(3):
            for cut in range(x[rows, f].max()):
                left = x[rows, f] <= cut
                if w[left].sum() >= 3 and w[~left].sum() >= 3:
                    gain = (w[left] @ y[rows][left]) ** 2 / w[left].sum() + (w[~left] @ y[rows][~left]) ** 2 / w[~left].sum() - base
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        if best[1] is None:
            plain[rows] = w @ y[rows] / w.sum()
        else:
            gains[best[1]] += best[0]
            grow(rows[x[rows, best[1]] <= best[2]])
            grow(rows[x[rows, best[1]] > best[2]])

    grow(np.arange(60))
    got, predicted = forest.grown(x, [5, 2, 9], y, drawn, 3)
    np.testing.assert_allclose(got, gains, rtol=1e-6)
    np.testing.assert_allclose(predicted, plain, rtol=1e-9)


def test_forests_are_fitted_on_all_rows(spark):
    """The share that a column explains hangs on a few far rows, so any part of the table would give another one."""
    rows = spark.range(24_000).select(
        F.when(F.col("id") % 400 == 7, "b").otherwise("a").alias("g"),
        F.when(F.col("id") % 800 == 7, 9000.0 + F.col("id") % 31).when(F.col("id") % 37 == 0, 300.0).otherwise(F.col("id") % 10).alias("y"),
    )
    means = rows.groupBy("g").agg(F.count("y").alias("n"), F.avg("y").alias("m"))
    grand = rows.agg(F.avg("y").alias("m"), F.var_pop("y").alias("v")).first()
    share = means.agg(F.sum(F.col("n") * (F.col("m") - grand["m"]) ** 2)).first()[0] / 24_000 / grand["v"]
    importance, r2, n = drivers.driver_models(rows, ["y"], ["g"], ["y"], trees=40)["y"]
    assert n == 24_000 and importance == {"g": 1.0} and r2 == pytest.approx(share, rel=0.02)


def test_forests_of_wide_tables_do_not_hang_on_the_partitions(spark, monkeypatch):
    """Cells of two words, gaps, several buckets of rows and slices of nodes."""
    monkeypatch.setattr(forest, "BUCKET_ROWS", 500)
    monkeypatch.setattr(forest, "MOST_SUMS", 700)
    df = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("g"),
        *[F.when(F.col("id") * (k + 3) % 11 != 0, (F.col("id") * (k + 7) * 7919 % (1000 + k)).cast("double")).alias(f"m{k}") for k in range(5)],
    ).withColumn("y", F.col("m1") * 3 + F.when(F.col("g") == "k1", 500).otherwise(0))
    names = ["y", *[f"m{k}" for k in range(5)]]
    one, many = (drivers.driver_models(df.repartition(p), ["y"], ["g"], names, trees=3)["y"] for p in (1, 5))
    assert one[0] == pytest.approx(many[0]) and one[1] == pytest.approx(many[1]) and one[2] == many[2] == 2727
    assert max(one[0], key=one[0].get) == "m1" and one[1] > 0.95


def test_slices_of_nodes_grow_the_same_tree(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 40, 900), rng.integers(0, 2, 900), rng.integers(0, 30, 900)]).astype(np.uint16)
    y, drawn = x[:, 0] * 2.0 + rng.normal(size=900), rng.poisson(1, 900)
    whole = forest.grown(x, [40, 2, 30], y, drawn, 3)
    monkeypatch.setattr(forest, "MOST_SUMS", 120)
    for a, b in zip(whole, forest.grown(x, [40, 2, 30], y, drawn, 3), strict=True):
        np.testing.assert_allclose(a, b)


@pytest.mark.parametrize("builtin", [5_000_000, 0])
def test_bin_ends_count_all_values(spark, builtin):
    rng = np.random.default_rng(8)
    columns = {"even": rng.integers(0, 50, 9000) * 1.0, "tail": np.exp(rng.normal(size=9000) * 4), "hot": np.where(rng.random(9000) < 0.6, 0.0, rng.normal(size=9000))}
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*columns.values(), strict=True)], "even double, tail double, hot double")
    spark.conf.set(quantiles.EXACT_VALUES_KEY, str(builtin))
    try:
        ends = quantiles.bin_ends(df.repartition(3), {**{c: F.col(c) for c in columns}, "none": F.lit(None)}, 64)
    finally:
        spark.conf.unset(quantiles.EXACT_VALUES_KEY)
    assert set(ends) == set(columns)
    for name, values in columns.items():
        if builtin:
            assert ends[name] == np.unique(np.quantile(values, np.arange(1, 64) / 64, method="lower")).tolist()
        held = np.bincount(np.searchsorted(ends[name], values, side="left"))
        most = max(9000 / 64 * (1 + 2 * quantiles.BIN_SLACK) + 1, np.unique(values, return_counts=True)[1].max() + 9000 / 64 * (1 + quantiles.BIN_SLACK))
        assert set(ends[name]) <= set(values) and held.max() <= most


def test_summary_of_a_small_business_table(spark):
    rows = [
        (i, dt.datetime(2026, 1 + i // 4, 1 + i), "North" if i % 2 else "South", 100.0 + 10 * i, 20.0 + 2 * i)
        for i in range(12)
    ]
    df = spark.createDataFrame(rows, "order_id long, order_date timestamp_ntz, region string, revenue double, profit double")
    result = summary.analyse(df, with_model=False)
    facts = result.overview.first()
    assert (facts["rows"], facts["columns"], facts["duplicate_rows"]) == (12, 5, 0)
    charts = [r["chart_type"] for r in result.recommended_charts.orderBy("position").collect()]
    assert charts[0] == "kpi" and len(charts) <= 6
    model = result.model.first()
    assert model["dataset_role"] == "fact" and model["grain_candidates"] == ["order_id"]
    lines = [r["text"] for r in result.takeaways.collect()]
    assert lines[0].startswith("Data quality note: No quality alert - ")
    assert 1 < len(lines) <= 4 and "confidence)" in lines[1]
    assert 1 <= result.key_insights.count() <= 8


@pytest.mark.parametrize("fn", [foundational.trend_insights, series.seasonality_insights, series.forecast_insights])
def test_nothing_without_columns(spark, fn):
    df = spark.createDataFrame([(1,)], "a long")
    assert rows_of(fn(df, [], [])) == []


def test_the_only_finding_is_in_the_last_of_many_columns(spark):
    """No detector stops at the first columns."""
    day = F.col("id").cast("int")
    when = F.add_months(F.lit("2024-01-01").cast("date"), F.floor(day / 20).cast("int")).cast("timestamp")
    wide = spark.range(480).select(
        *[F.lit("2024-01-01").cast("timestamp").alias(f"t{i}") for i in range(3)],
        when.alias("when"),
        *[F.lit("same").alias(f"d{i}") for i in range(7)],
        F.when(day % 3 == 0, "A").otherwise("B").alias("last_dimension"),
        *[F.lit(5.0).alias(f"m{i:02d}") for i in range(12)],
        (F.when(day % 3 == 0, 40.0).otherwise(1.0) + F.floor(day / 20) * 10 + F.when(day % 240 < 20, 300.0).otherwise(0.0)).alias("loud"),
    )
    rising = wide.columns
    spiked = spark.range(480).select(*[F.lit(5.0).alias(m) for m in rising[-13:-1]], F.when(day == 7, 450.0).otherwise(day % 9).alias("loud"))
    dates = ["t0", "t1", "t2", "when"]
    dims, measures = [f"d{i}" for i in range(7)] + ["last_dimension"], [f"m{i:02d}" for i in range(12)] + ["loud"]
    for found in (
        segments.anomaly_insights(spiked, measures),
        segments.segment_driver_insights(wide, dims, measures),
        series.seasonality_insights(wide, dates, measures),
        series.forecast_insights(wide, dates, measures),
        series.decomposition_insights(wide, dates, measures),
        foundational.trend_insights(wide, dates, measures),
        series.variance_insights(wide, dates, dims, measures),
    ):
        kinds = [(r["kind"], r["chart_columns"]) for r in found.collect()]
        assert kinds and "loud" in kinds[0][1], kinds
    ids = spark.range(400).select(
        F.lit("2024-01-01").cast("timestamp").alias("first"),
        F.add_months(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).cast("timestamp").alias("second"),
        F.col("id").alias("once_id"),
        (F.col("id") % 60 + F.floor(F.col("id") / 200) * 0).alias("again_id"),
    )
    assert journeys.retention_insights(ids, ["first", "second"], ["once_id", "again_id"]).count() <= 1
    assert journeys.funnel_columns(["paid", "visit", "view", "lead", "signup", "trial", "cart"])[-1] == "paid"


def test_summary_leaves_no_cache(spark):
    summary.analyse(spark.range(40).selectExpr("id % 3 AS k", "id * 1.5 AS amount"), with_model=False).key_insights.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
