"""Ranks and gaps over ordered timestamps without a single-partition window.

The distinct timestamps of a table may be as many as its rows, so they are folded along the
calendar instead of being ordered in one task: microseconds within a second (at most 10^6),
seconds within a day (at most 86,400), days (bounded by the calendar). Every window partition
is bounded by the calendar, whatever the data looks like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import epoch_micros

SECONDS_PER_DAY = 86_400


def ordinal_regression(series: DataFrame, ts: str = "ts", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Least squares of ``y`` on the 0-based rank of its distinct ``ts``, per group of ``by``.

    Columns: n, slope, intercept, r, first_y, last_y, first_ts, last_ts. Means and co-moments are
    merged unit by unit (never raw sums of squares), so large levels do not cancel.
    """
    by = by or []
    second = F.floor(epoch_micros(F.col(ts)) / 1_000_000)
    points = series.select(*by, F.col(ts).alias("t"), second.alias("sec"), F.col(y).alias("y"))
    in_second = Window.partitionBy(*by, "sec").orderBy("t")
    seconds = (
        points.withColumn("x", (F.row_number().over(in_second) - 1).cast("double"))
        .groupBy(*by, "sec")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("y").alias("mean"),
            (F.var_pop("y") * F.count(F.lit(1))).alias("m2"),
            (F.covar_pop("x", "y") * F.count(F.lit(1))).alias("cxy"),
            F.min_by("y", "t").alias("y0"),
            F.max_by("y", "t").alias("y1"),
            F.min("t").alias("t0"),
            F.max("t").alias("t1"),
        )
    )
    days = _fold(seconds.withColumn("day", F.floor(F.col("sec") / SECONDS_PER_DAY)), by + ["day"])
    total = _fold(days, by)
    n = F.col("n").cast("double")
    sxx = n * (n * n - 1) / 12
    slope = F.try_divide(F.col("cxy"), sxx)
    r = F.col("cxy") / F.sqrt(sxx * F.col("m2"))
    return total.select(
        *by,
        "n",
        slope.alias("slope"),
        (F.col("mean") - slope * (n - 1) / 2).alias("intercept"),
        F.when((sxx > 0) & (F.col("m2") > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"),
        F.col("y0").alias("first_y"),
        F.col("y1").alias("last_y"),
        F.col("t0").alias("first_ts"),
        F.col("t1").alias("last_ts"),
    )


def _fold(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge consecutive calendar units into the next larger one.

    The x values of a unit are its own ranks moved by the number of points before it, so its
    centre is known without storing it and its own co-moment does not change.
    """
    unit = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = unit.orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        "*",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(unit).alias("all_n"),
        F.sum(F.col("n") * F.col("mean")).over(unit).alias("all_y"),
    )
    dx = F.col("before") + (F.col("n") - 1) / 2 - (F.col("all_n") - 1) / 2
    dy = F.col("mean") - F.col("all_y") / F.col("all_n")
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum(F.col("m2") + F.col("n") * dy * dy).alias("m2"),
        F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"),
        F.min_by("y0", "t0").alias("y0"),
        F.max_by("y1", "t1").alias("y1"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
    )


def gap_counts(df: DataFrame, ts: str) -> DataFrame:
    """Gaps between consecutive rows ordered by ``ts`` as (gap_seconds, frequency).

    Rows sharing a timestamp contribute zero gaps; gaps across seconds and days are taken from
    the first and last timestamp of neighbouring units.
    """
    stamps = (
        df.where(F.col(ts).isNotNull())
        .groupBy(F.col(ts).alias("t"))
        .agg(F.count(F.lit(1)).alias("c"))
        .select(epoch_micros(F.col("t")).alias("t"), "c")
        .withColumn("sec", F.floor(F.col("t") / 1_000_000))
    )
    repeats = stamps.agg(F.lit(0).cast("long").alias("gap"), F.sum(F.col("c") - 1).alias("freq"))
    in_second = Window.partitionBy("sec").orderBy("t")
    within = stamps.select("sec", "t", (F.col("t") - F.lag("t").over(in_second)).alias("gap"))
    seconds = stamps.groupBy("sec").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    seconds = seconds.withColumn("day", F.floor(F.col("sec") / SECONDS_PER_DAY))
    in_day = Window.partitionBy("day").orderBy("sec")
    across_seconds = seconds.select((F.col("t0") - F.lag("t1").over(in_day)).alias("gap"))
    days = seconds.groupBy("day").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    all_days = Window.partitionBy(F.lit(0)).orderBy("day")
    across_days = days.select((F.col("t0") - F.lag("t1").over(all_days)).alias("gap"))
    parts = [p.select("gap", F.lit(1).cast("long").alias("freq")) for p in (within, across_seconds, across_days)]
    merged = reduce(DataFrame.unionByName, parts, repeats).where(F.col("gap").isNotNull() & (F.col("freq") > 0))
    return merged.groupBy("gap").agg(F.sum("freq").alias("freq")).select(
        (F.col("gap") / 1_000_000).alias("gap_seconds"), F.col("freq")
    )
