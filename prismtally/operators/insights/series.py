"""Monthly-series detectors: seasonality, forecast, decomposition, variance explanation.

All work on the monthly totals, which the calendar bounds; months without rows are skipped, so
positions are ranks of observed months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import as_text, local_frame, moment, number, period_start
from prismtally.functions.stats import anova, correlation_p_value, pearson, with_f_p_value
from prismtally.operators.filters import not_before
from prismtally.operators.insights.common import findings, fixed, grouped, month_totals, no_findings, say

# Gates and limits of the detectors.
SEASON_ROWS, SEASON_MONTHS, SEASON_STRENGTH, SEASONS = 12, 6, 0.15, 1
FORECAST_ROWS, FORECAST_MONTHS, FORECAST_CHANGE, FORECAST_R, FORECASTS = 12, 6, 0.05, 0.35, 1
HORIZON, MONTHS_PER_STEP = 3, 6
SPLIT_ROWS, SPLIT_MONTHS, SPLIT_TREND, SPLIT_SEASON, SPLITS = 16, 8, 0.08, 0.1, 1
CHANGE_ROWS, CHANGE_SHARE, CHANGES = 12, 20, 2


def _months(df: DataFrame, date: str, measures: list[str], shared: dict[str, DataFrame] | None) -> DataFrame:
    """The monthly totals, taken from ``shared`` (date column to totals) where they exist already."""
    if shared and date in shared:
        return shared[date].where(F.col("measure").isin(measures))
    return month_totals(df, date, measures)


def _per_date(df: DataFrame, dates: list[str], measures: list[str], shared: dict[str, DataFrame] | None, table) -> DataFrame:
    """``table`` of the monthly totals by each date column, with ``date_column``."""
    parts = [table(_months(df, d, measures, shared)).withColumn("date_column", F.lit(d)) for d in dates]
    return reduce(DataFrame.unionByName, parts)


def _base(value):
    """The absolute value, 1 where it is 0."""
    return F.when(value == 0, F.lit(1.0)).otherwise(F.abs(value))


def seasonality_table(months: DataFrame) -> DataFrame:
    """Per measure: spread of the month-of-year means, its strength, peak, trough and the ANOVA."""
    per_year = months.withColumn("moy", F.month("month"))
    profile = per_year.groupBy("measure", "moy").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total").alias("mean"),
        (F.var_pop("total") * F.count(F.lit(1))).alias("m2"),
        F.sum("n").alias("rows"),
    )
    summary = profile.groupBy("measure").agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("months"),
        (F.max("mean") - F.min("mean")).alias("spread"),
        F.avg("mean").alias("level"),
        F.count_distinct("mean").alias("levels"),
        F.min_by("moy", F.struct(-F.col("mean"), F.col("moy"))).alias("peak"),
        F.max_by("moy", F.struct(-F.col("mean"), F.col("moy"))).alias("trough"),
    )
    return summary.join(anova(profile, ["measure"]), "measure", "left").withColumn(
        "strength", F.col("spread") / _base(F.col("level"))
    ).withColumn("eta_squared", F.coalesce("eta_squared", F.lit(0.0)))


def seasonality_insights(
    df: DataFrame, dates: list[str], measures: list[str], shared: dict[str, DataFrame] | None = None
) -> DataFrame:
    """I9."""
    if not dates or not measures:
        return no_findings(df)
    seasonal = with_f_p_value(_per_date(df, dates, measures, shared, seasonality_table)).where(
        (F.col("rows") >= SEASON_ROWS)
        & (F.col("months") >= SEASON_MONTHS)
        & (F.col("levels") >= 2)
        & (F.col("strength") >= SEASON_STRENGTH)
    )
    peak, trough = F.col("peak").cast("string"), F.col("trough").cast("string")
    return findings(
        seasonal,
        SEASONS,
        ["Monthly totals are compared by month of the year.", "Only swings large against the usual level are shown."],
        kind=F.lit("seasonality"),
        title=say(F.col("measure"), " shows a repeating month pattern"),
        detail=say(
            "Over the years the totals of month ", peak, " are the highest and those of month ", trough, " the lowest.",
        ),
        score=F.round(F.abs("spread"), 3),
        stat=say("month ", peak, " vs month ", trough),
        chart_type=F.lit("line"),
        chart_columns=F.array("date_column", "measure"),
        sample_size=F.col("months"),
        effect=F.greatest(F.col("eta_squared"), F.col("strength")),
        p=F.col("p"),
        stability=F.least(F.lit(1.0), F.col("strength")),
    )


def _ranked(months: DataFrame) -> DataFrame:
    spec = Window.partitionBy("measure").orderBy("month")
    return months.withColumn("x", (F.row_number().over(spec) - 1).cast("double"))


def forecast_table(months: DataFrame) -> DataFrame:
    """Per measure: line through the monthly totals and the next value against the latest one."""
    fitted = (
        _ranked(months)
        .groupBy("measure")
        .agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("months"),
            F.regr_slope("total", "x").alias("slope"),
            F.regr_intercept("total", "x").alias("intercept"),
            pearson("total", "x").alias("r"),
            F.max_by("total", "x").alias("latest"),
        )
    )
    following = F.col("intercept") + F.col("slope") * F.col("months")
    return fitted.withColumn("next", following).withColumn(
        "delta_pct", (F.col("next") - F.col("latest")) / _base(F.col("latest"))
    )


def forecast_values(months: DataFrame) -> DataFrame:
    """(measure, step, value) for the horizon of one to three further months."""
    horizon = F.least(F.lit(HORIZON), F.greatest(F.lit(1), F.floor(F.col("months") / MONTHS_PER_STEP)))
    steps = F.explode(F.sequence(F.lit(1), horizon.cast("int"))).alias("step")
    value = F.col("intercept") + F.col("slope") * (F.col("months") + F.col("step") - 1)
    return (
        forecast_table(months)
        .where((F.col("rows") >= FORECAST_ROWS) & (F.col("months") >= FORECAST_MONTHS))
        .select("*", steps)
        .select("measure", F.col("step").cast("long").alias("step"), value.alias("value"))
    )


def forecast_insights(
    df: DataFrame, dates: list[str], measures: list[str], shared: dict[str, DataFrame] | None = None
) -> DataFrame:
    """I10."""
    if not dates or not measures:
        return no_findings(df)
    pct, strength = F.col("delta_pct"), F.coalesce(F.abs(F.nanvl("r", F.lit(0.0))), F.lit(0.0))
    moving = (
        _per_date(df, dates, measures, shared, forecast_table)
        .where((F.col("rows") >= FORECAST_ROWS) & (F.col("months") >= FORECAST_MONTHS) & F.col("slope").isNotNull())
        .where((F.abs(pct) >= FORECAST_CHANGE) | (strength >= FORECAST_R))
        .withColumn("p", correlation_p_value("r", "months"))
    )
    way = F.when(F.col("next") >= F.col("latest"), "grow").otherwise("decline")
    return findings(
        moving,
        FORECASTS,
        ["A straight line through monthly totals, easy to check.", "Directional guidance only."],
        kind=F.lit("forecast"),
        title=say(F.col("measure"), " is projected to ", way, " next period"),
        detail=say(
            "The line through the months reaches ", grouped(F.col("next")), " after ", grouped(F.col("latest")), " in the last one.",
        ),
        score=F.round(F.abs(pct) * 100, 3),
        stat=say("next period ", grouped(F.col("next")), " (", F.format_string("%+.1f", pct * 100), "%)"),
        chart_type=F.lit("line"),
        chart_columns=F.array("date_column", "measure"),
        sample_size=F.col("months"),
        effect=F.greatest(F.abs(pct), strength),
        p=F.col("p"),
    )


def decomposition_table(months: DataFrame) -> DataFrame:
    """Per measure: change of the centred 3-month mean and swing of the month-of-year residuals."""
    spec = Window.partitionBy("measure").orderBy("month")
    smooth = months.select(
        "measure", "month", "total", "n", F.avg("total").over(spec.rowsBetween(-1, 1)).alias("trend")
    )
    seasonal = (
        smooth.groupBy("measure", F.month("month").alias("moy"))
        .agg(F.avg(F.col("total") - F.col("trend")).alias("residual"))
        .groupBy("measure")
        .agg(
            (F.max("residual") - F.min("residual")).alias("seasonal_range"),
            F.min_by("moy", F.struct(-F.col("residual"), F.col("moy"))).alias("strongest"),
            F.min_by("moy", F.struct(F.col("residual"), F.col("moy"))).alias("weakest"),
        )
    )
    level = smooth.groupBy("measure").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("months"),
        (F.max_by("trend", "month") - F.min_by("trend", "month")).alias("trend_change"),
        F.avg("total").alias("mean"),
    )
    return level.join(seasonal, "measure").withColumn("base", _base(F.col("mean")))


def decomposition_insights(
    df: DataFrame, dates: list[str], measures: list[str], shared: dict[str, DataFrame] | None = None
) -> DataFrame:
    """I11."""
    if not dates or not measures:
        return no_findings(df)
    trend, season = F.abs("trend_change") / F.col("base"), F.col("seasonal_range") / F.col("base")
    split = _per_date(df, dates, measures, shared, decomposition_table).where(
        (F.col("rows") >= SPLIT_ROWS)
        & (F.col("months") >= SPLIT_MONTHS)
        & ((trend >= SPLIT_TREND) | (season >= SPLIT_SEASON))
    )
    change, swing = grouped(F.col("trend_change")), grouped(F.col("seasonal_range"))
    return findings(
        split,
        SPLITS,
        ["A smoothed series gives the trend, the rest the season.", "Separates momentum from calendar effects."],
        kind=F.lit("decomposition"),
        title=say(F.col("measure"), " can be split into trend and recurring pattern"),
        detail=say(
            "Smoothed, it changed by ", change, "; around that, the months of the year swing by ", swing, "."
        ),
        score=F.round(F.greatest(F.abs("trend_change"), F.abs("seasonal_range")), 3),
        stat=say("trend delta ", change, " / seasonal range ", swing),
        chart_type=F.lit("line"),
        chart_columns=F.array("date_column", "measure"),
        sample_size=F.col("months"),
        effect=F.greatest(trend, season),
        stability=F.least(F.lit(1.0), season),
    )


def variance_table(
    df: DataFrame, date: str, dimensions: list[str], measures: list[str], shared: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The segment that moved most between the two latest months, per measure and dimension.

    The two months of each measure are read from the monthly totals (a few rows); the second
    scan then reads only those months (the bound reaches the file scan) and keeps one counter
    per segment. Segments absent from both months did not move.
    """
    latest_two = Window.partitionBy("measure").orderBy(F.desc("month"))
    bounds = (
        _months(df, date, measures, shared)
        .withColumn("age", F.row_number().over(latest_two))
        .withColumn("rows", F.sum("n").over(Window.partitionBy("measure")))
        .where(F.col("age") <= 2)
        .groupBy("measure")
        .agg(
            F.max("rows").alias("rows"),
            F.max("month").alias("latest"),
            F.min("month").alias("previous"),
            F.max(F.when(F.col("age") == 1, F.col("total"))).alias("latest_total"),
            F.max(F.when(F.col("age") == 2, F.col("total"))).alias("previous_total"),
        )
        .where((F.col("rows") >= CHANGE_ROWS) & F.col("previous_total").isNotNull())
        .where(F.col("latest_total") != F.col("previous_total"))
        .collect()
    )
    if not bounds:
        schema = (
            "measure string, dimension string, segment string, delta double, support bigint, "
            "total_delta double, base double, latest string, previous string"
        )
        return df.sparkSession.createDataFrame([], schema)
    when = moment(df, date)
    recent = df.where(not_before(df, date, str(min(b["previous"] for b in bounds))))
    entries = []
    for b in bounds:
        for d in dimensions:
            entries.append(
                F.struct(
                    F.lit(b["measure"]).alias("measure"),
                    F.lit(d).alias("dimension"),
                    as_text(df, d).alias("segment"),
                    number(df, b["measure"]).alias("v"),
                    F.when(F.col("_month") == F.lit(b["latest"]), 1.0)
                    .when(F.col("_month") == F.lit(b["previous"]), -1.0)
                    .alias("sign"),
                )
            )
    moved = (
        recent.withColumn("_month", period_start(when, "month"))
        .select(F.inline(F.array(*entries)))
        .where(F.col("segment").isNotNull() & F.col("v").isNotNull() & F.col("sign").isNotNull())
        .groupBy("measure", "dimension", "segment")
        .agg(F.sum(F.col("v") * F.col("sign")).alias("delta"), F.count(F.lit(1)).alias("support"))
    )
    largest = moved.groupBy("measure", "dimension").agg(
        F.min_by(
            F.struct("segment", "delta", "support"), F.struct(-F.abs("delta"), F.col("segment"))
        ).alias("top")
    )
    totals = local_frame(
        df.sparkSession,
        [
            (
                b["measure"],
                b["latest_total"] - b["previous_total"],
                abs(b["previous_total"]) or 1.0,
                b["latest"].strftime("%Y-%m"),
                b["previous"].strftime("%Y-%m"),
            )
            for b in bounds
        ],
        "measure string, total_delta double, base double, latest string, previous string",
    )
    return largest.join(F.broadcast(totals), "measure").select(
        "measure", "dimension", "top.segment", "top.delta", "top.support", "total_delta", "base", "latest", "previous"
    )


def variance_insights(
    df: DataFrame,
    dates: list[str],
    dimensions: list[str],
    measures: list[str],
    shared: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """I12."""
    if not dates or not dimensions or not measures:
        return no_findings(df)
    share = F.abs(F.col("delta") / F.col("total_delta") * 100)
    table = reduce(DataFrame.unionByName, [variance_table(df, d, dimensions, measures, shared) for d in dates])
    explained = table.withColumn("share", share).where(F.col("share") >= CHANGE_SHARE)
    return findings(
        explained,
        CHANGES,
        ["The latest month is compared with the one before.", "The segment that moved most is named, not the largest."],
        kind=F.lit("variance_explanation"),
        title=say(F.col("dimension"), " explains the latest change in ", F.col("measure")),
        detail=say(
            "In ", F.col("segment"), " it moved by ", grouped(F.col("delta")), ", ", fixed(F.col("share"), 1), "% of the net change.",
        ),
        score=F.round(F.abs("delta"), 3),
        stat=say(F.col("latest"), " vs ", F.col("previous")),
        chart_type=F.lit("bar"),
        chart_columns=F.array("dimension", "measure"),
        sample_size=F.col("support"),
        effect=F.greatest(F.col("share") / 100, F.abs("total_delta") / F.col("base")),
        stability=F.least(F.lit(1.0), F.col("share") / 100),
    )
