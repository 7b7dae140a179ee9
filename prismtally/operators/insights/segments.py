"""Anomaly, segment driver and contribution detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import number
from prismtally.functions.quantiles import quantile_row
from prismtally.functions.stats import anova_columns, with_f_p_value
from prismtally.operators.insights.common import findings, fixed, grouped, no_findings, say, segment_stats

# Gates and limits; the normal scale enters twice, as the reference result does.
ANOMALY_ROWS, ROBUST_Z, ANOMALIES = 12, 3.5, 2
Z_FACTOR, NORMAL_SCALE = 0.6745, 0.6744897501960817
SEGMENT_VALUES = 12
DRIVER_ROWS, DRIVER_P, DRIVER_GAP, DRIVERS = 20, 0.1, 0.35, 3
SHARE_ROWS, TOP_SHARE, CONTRIBUTIONS = 10, 35, 2


def anomaly_table(df: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, n, median, mad, outliers, top_value, max_z): medians and median deviations of all
    measures by exact selection, then one counting scan."""
    schema = "measure string, n bigint, median double, mad double, outliers bigint, top_value double, max_z double"
    if not measures:
        return df.sparkSession.createDataFrame([], schema)
    medians = quantile_row(df, {m: number(df, m) for m in measures}, [0.5])
    usable = [m for m in measures if medians[m] is not None]
    deviations = quantile_row(df, {m: F.abs(number(df, m) - medians[m][0]) for m in usable}, [0.5])
    usable = [m for m in usable if deviations[m][0] > 0]
    if not usable:
        return df.sparkSession.createDataFrame([], schema)
    aggs, entries = [], []
    for i, m in enumerate(usable):
        v, mad = number(df, m), deviations[m][0] / NORMAL_SCALE
        z = F.abs(F.lit(Z_FACTOR) * (v - medians[m][0]) / mad)
        out = F.when(z >= ROBUST_Z, v)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(out).alias(f"o{i}"),
            F.max_by(out, F.struct(F.abs(out), out)).alias(f"t{i}"),
            F.max(z).alias(f"z{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(m).alias("measure"), F.col(f"n{i}").alias("n"), F.lit(medians[m][0]).alias("median"),
                F.lit(mad).alias("mad"), F.col(f"o{i}").alias("outliers"), F.col(f"t{i}").alias("top_value"),
                F.col(f"z{i}").alias("max_z"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def anomaly_insights(df: DataFrame, measures: list[str]) -> DataFrame:
    """I5."""
    if not measures:
        return no_findings(df)
    found = anomaly_table(df, measures).where((F.col("n") >= ANOMALY_ROWS) & (F.col("outliers") > 0))
    return findings(
        found,
        ANOMALIES,
        ["Distances from the median resist the extremes they measure.", "Extremes can move averages and forecasts."],
        kind=F.lit("anomaly"),
        title=say(F.col("measure"), " shows statistically unusual values"),
        detail=say(
            "The value furthest from the median is ",
            grouped(F.col("top_value")),
            ".",
        ),
        score=F.round("max_z", 3),
        stat=say(F.col("outliers").cast("string"), " outliers (robust z >= 3.5)"),
        chart_type=F.lit("box"),
        chart_columns=F.array("measure"),
        sample_size=F.col("n"),
        effect=F.least(F.lit(3.0), F.col("max_z")) / 3.5,
        stability=F.least(F.lit(1.0), F.col("outliers") / F.greatest(F.col("n") * 0.1, F.lit(1))),
    )


PAIR = ["dimension", "measure"]


def driver_table(stats: DataFrame) -> DataFrame:
    """Spread of segment means, its size against the overall deviation, and the ANOVA, per pair, in one aggregate.

    The two grand means (of all segments, and of those of two rows or more, which the ANOVA compares) come from windows over
    the at most 12 segments of a pair.
    """
    pair = Window.partitionBy(*PAIR)
    big = F.when(F.col("n") >= 2, F.col("n"))
    grand = F.sum(F.col("n") * F.col("mean")).over(pair) / F.sum("n").over(pair)
    big_grand = F.try_divide(F.sum(big * F.col("mean")).over(pair), F.sum(big).over(pair))
    placed = stats.withColumns({"off": F.col("mean") - grand, "big": big, "big_off": F.col("mean") - big_grand})
    spread = placed.groupBy(*PAIR).agg(
        F.sum("n").alias("rows"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count(F.lit(1)).alias("groups_seen"),
        F.sqrt(F.sum(F.col("m2") + F.col("n") * F.col("off") * F.col("off")) / F.sum("n")).alias("pooled_std"),
        F.min_by("segment", F.struct(-F.col("mean"), F.col("segment"))).alias("top_segment"),
        F.max_by("segment", F.struct(-F.col("mean"), F.col("segment"))).alias("bottom_segment"),
        (F.max("mean") - F.min("mean")).alias("spread"),
        F.count("big").alias("groups"),
        F.sum("big").alias("total_n"),
        F.sum(F.col("big") * F.col("big_off") * F.col("big_off")).alias("ss_between"),
        F.sum(F.when(F.col("big").isNotNull(), F.col("m2"))).alias("ss_within"),
    )
    gap = F.when(F.col("pooled_std") > 0, F.abs(F.col("spread") / F.col("pooled_std"))).otherwise(F.abs("spread"))
    return spread.select("*", *anova_columns()).withColumn("gap", gap)


def segment_driver_insights(df: DataFrame, dimensions: list[str], measures: list[str], stats: DataFrame | None = None) -> DataFrame:
    """I6 with I7; ``stats`` may be shared with the contribution detector."""
    if stats is None:
        stats = segment_stats(df, dimensions, measures, SEGMENT_VALUES)
    separated = (
        with_f_p_value(driver_table(stats))
        .where((F.col("rows") >= DRIVER_ROWS) & (F.col("lo") < F.col("hi")) & (F.col("groups_seen") >= 2))
        .where(F.col("p").isNull() | (F.col("p") <= DRIVER_P))
        .where((F.col("spread") != 0) & (F.col("gap") >= DRIVER_GAP))
    )
    return findings(
        separated,
        DRIVERS,
        ["Segment averages are compared, so sizes do not decide.", "Confidence weighs sample and separation."],
        kind=F.lit("segment_driver"),
        title=say(F.col("dimension"), " strongly separates ", F.col("measure")),
        detail=say(
            "On average ", F.col("top_segment"), " is ", grouped(F.col("spread")), " above ", F.col("bottom_segment"), ".",
        ),
        score=F.round(F.abs("spread"), 3),
        stat=say(F.col("top_segment"), " vs ", F.col("bottom_segment")),
        chart_type=F.lit("bar"),
        chart_columns=F.array("dimension", "measure"),
        sample_size=F.col("rows"),
        effect=F.greatest(F.col("eta_squared"), F.col("gap") / 3),
        p=F.col("p"),
    )


def contribution_table(stats: DataFrame) -> DataFrame:
    """Top share and concentration (sum of squared shares) per dimension and measure."""
    pair = Window.partitionBy(*PAIR)
    shares = stats.withColumn("grand_total", F.sum("total").over(pair)).withColumn(
        "share", F.try_divide(F.col("total"), F.col("grand_total"))
    )
    return shares.groupBy(*PAIR).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("groups_seen"),
        F.first("grand_total").alias("grand_total"),
        F.min_by("segment", F.struct(-F.col("share"), F.col("segment"))).alias("top_segment"),
        (F.max("share") * 100).alias("top_share"),
        F.sum(F.col("share") * F.col("share")).alias("concentration"),
    )


def contribution_insights(df: DataFrame, dimensions: list[str], measures: list[str], stats: DataFrame | None = None) -> DataFrame:
    """I8."""
    if stats is None:
        stats = segment_stats(df, dimensions, measures, SEGMENT_VALUES)
    share = F.col("top_share")
    dominant = contribution_table(stats).where(
        (F.col("rows") >= SHARE_ROWS) & (F.col("grand_total") != 0) & (F.col("groups_seen") >= 2) & (share >= TOP_SHARE)
    )
    return findings(
        dominant,
        CONTRIBUTIONS,
        ["Contribution is a segment's share of the total.", "High concentration is a dependency or an opportunity."],
        kind=F.lit("contribution"),
        title=say(F.col("top_segment"), " dominates contribution to ", F.col("measure")),
        detail=say("Of all ", F.col("measure"), ", ", fixed(share, 2), "% comes from ", F.col("top_segment"), "."),
        score=F.round(share, 3),
        stat=say(fixed(share, 2), "% share"),
        chart_type=F.lit("bar"),
        chart_columns=F.array("dimension", "measure"),
        sample_size=F.col("rows"),
        effect=F.greatest(F.col("concentration"), share / 100),
        stability=F.least(F.lit(1.0), share / 60),
    )
