"""Shared pieces of the detectors: number texts, segment and month aggregates, the findings frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import as_text, moment, number, period_start
from prismtally.functions.scoring import enrich, strongest

FINDING_SCHEMA = (
    "kind string, title string, detail string, score double, stat string, chart_type string, "
    "chart_columns array<string>, sample_size bigint, effect_size double, p_value double, "
    "confidence_score double, confidence_label string, priority_score double, why array<string>"
)


def fixed(value: Column, digits: int) -> Column:
    """Text with a set number of decimals."""
    return F.format_string(f"%.{digits}f", value)


def grouped(value: Column) -> Column:
    """Text with thousands separators and two decimals."""
    return F.format_number(value, 2)


def plain(value: Column, digits: int = 2) -> Column:
    """A rounded number as text without padding zeros, at least one decimal."""
    trimmed = F.regexp_replace(F.format_string(f"%.{digits}f", value), "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def null_double() -> Column:
    return F.lit(None).cast("double")


def findings(rows: DataFrame, limit: int, why: list[str], **fields: Column) -> DataFrame:
    """Scored findings from statistic rows; ``p`` and ``stability`` are null unless given."""
    fields.setdefault("p", null_double())
    fields.setdefault("stability", null_double())
    raw = rows.select(*[c.alias(n) for n, c in fields.items()], F.array(*[F.lit(w) for w in why]).alias("why"))
    return strongest(enrich(raw), limit)


def no_findings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDING_SCHEMA)


def few_valued(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    """Columns that can have at most ``limit`` distinct values, by sketch in one scan.

    A sketch of 5 % error cannot double a count, so no qualifying column is lost; the exact test
    follows on the aggregated values. It keeps long text columns out of the exact shuffles.
    """
    if not columns:
        return []
    row = df.agg(*[F.approx_count_distinct(as_text(df, c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] <= 2 * limit]


def segment_stats(df: DataFrame, dimensions: list[str], measures: list[str], max_segments: int) -> DataFrame:
    """(dimension, segment, measure, n, total, mean, m2, lo, hi) for every pair, in one scan.

    Every row feeds one counter per dimension; partial aggregation leaves at most a few segments
    per task, so the shuffle is tiny whatever the table size and however skewed the segments.
    """
    dims = few_valued(df, dimensions, max_segments)
    if not dims or not measures:
        return df.sparkSession.createDataFrame(
            [],
            "dimension string, segment string, measure string, n bigint, total double, mean double, m2 double, "
            "lo double, hi double, segments bigint",
        )
    entries = [F.struct(F.lit(d).alias("dimension"), as_text(df, d).alias("segment")) for d in dims]
    rows = df.select(
        F.explode(F.array(*entries)).alias("e"), *[number(df, m).alias(f"v{i}") for i, m in enumerate(measures)]
    ).where(F.col("e.segment").isNotNull())
    aggs = []
    for i in range(len(measures)):
        v = F.col(f"v{i}")
        aggs += [
            F.count(v).alias(f"n{i}"), F.sum(v).alias(f"t{i}"), F.avg(v).alias(f"a{i}"),
            (F.var_pop(v) * F.count(v)).alias(f"m{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
        ]
    wide = rows.groupBy(F.col("e.dimension").alias("dimension"), F.col("e.segment").alias("segment")).agg(*aggs)
    # The sketch leaves at most a few dozen segments per dimension.
    counted = wide.withColumn("segments", F.count(F.lit(1)).over(Window.partitionBy("dimension")))
    kept = counted.where(F.col("segments").between(2, max_segments))
    per_measure = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total"),
                F.col(f"a{i}").alias("mean"), F.col(f"m{i}").alias("m2"), F.col(f"l{i}").alias("lo"),
                F.col(f"h{i}").alias("hi"),
            )
            for i, m in enumerate(measures)
        ]
    )
    return kept.select("dimension", "segment", "segments", F.inline(per_measure)).where(F.col("n") > 0)


def month_totals(df: DataFrame, date: str, measures: list[str]) -> DataFrame:
    """(measure, month, total, n): monthly sums of all measures in one scan; months without values are absent."""
    rows = df.select(
        period_start(moment(df, date), "month").alias("month"),
        *[number(df, m).alias(f"v{i}") for i, m in enumerate(measures)],
    ).where(F.col("month").isNotNull())
    aggs = []
    for i in range(len(measures)):
        aggs += [F.sum(f"v{i}").alias(f"t{i}"), F.count(f"v{i}").alias(f"n{i}")]
    wide = rows.groupBy("month").agg(*aggs)
    entries = [
        F.struct(F.lit(m).alias("measure"), F.col(f"t{i}").alias("total"), F.col(f"n{i}").alias("n"))
        for i, m in enumerate(measures)
    ]
    return wide.select("month", F.inline(F.array(*entries))).where(F.col("n") > 0)
