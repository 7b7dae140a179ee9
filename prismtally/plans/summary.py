"""The analysis summary: detectors, ranking, chart recommendations, takeaways."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import categorical_columns, numeric_columns
from prismtally.functions.scoring import FINDING_FIELDS
from prismtally.operators.insights import drivers, foundational, journeys, segments, series
from prismtally.operators.insights.common import month_totals, segment_stats
from prismtally.operators.profile import overview, quality_alerts
from prismtally.operators.semantics import dataset_model, infer_semantics
from prismtally.session import checkpointed

# Fixed values.
ADVANCED, KEY_INSIGHTS, RECOMMENDATIONS, TAKEAWAYS, TAKEAWAY_INSIGHTS = 6, 8, 6, 4, 3


@dataclass(frozen=True)
class Roles:
    """Column names by semantic role, in column order; measures that are averaged by default."""

    measures: list[str]
    dimensions: list[str]
    dates: list[str]
    identifiers: list[str]
    averaged: frozenset[str]


def roles_of(semantics: DataFrame) -> Roles:
    """One row per column comes to the driver; it decides which detectors run on what."""
    rows = semantics.select("position", "name", "semantic_role", "default_aggregation").orderBy("position").collect()

    def of(role: str) -> list[str]:
        return [r["name"] for r in rows if r["semantic_role"] == role]

    averaged = frozenset(r["name"] for r in rows if r["default_aggregation"] == "average")
    return Roles(of("measure"), of("dimension"), of("datetime"), of("identifier"), averaged)


def ranked(findings: DataFrame, limit: int) -> DataFrame:
    """By priority, confidence and score; ties by kind and title."""
    return findings.orderBy(
        F.desc("priority_score"), F.desc("confidence_score"), F.desc("score"), "kind", "title"
    ).limit(limit)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*FINDING_FIELDS) for p in parts])


def advanced_insights(df: DataFrame, roles: Roles, with_model: bool = True, trees: int = drivers.TREES) -> DataFrame:
    """I5-I15 over the semantic groups, best six.

    Detectors of one family share their aggregate: segment statistics feed I6 and I8, monthly
    totals I9-I12. The shared frames are a few rows; they are released once the findings are written, which are six rows.
    """
    m, d, t = roles.measures, roles.dimensions, roles.dates
    stats = None
    if m and d:
        stats = segment_stats(
            df, d, m, segments.SEGMENT_VALUES
        ).persist(StorageLevel.MEMORY_AND_DISK)
    shared = {date: month_totals(df, date, m).persist(StorageLevel.MEMORY_AND_DISK) for date in (t if m else [])}
    parts = [
        segments.anomaly_insights(df, m),
        series.seasonality_insights(df, t, m, shared),
        series.forecast_insights(df, t, m, shared),
        series.decomposition_insights(df, t, m, shared),
        series.variance_insights(df, t, d, m, shared),
        journeys.funnel_insights(df, m),
        journeys.retention_insights(df, t, roles.identifiers),
    ]
    if stats is not None:
        parts += [
            segments.segment_driver_insights(df, d, m, stats),
            segments.contribution_insights(df, d, m, stats),
        ]
    if with_model:
        parts.append(drivers.model_driver_insights(df, d, m, trees))
    best = checkpointed(ranked(union(parts), ADVANCED))
    for frame in [*shared.values(), *([stats] if stats is not None else [])]:
        frame.unpersist()
    return best


def key_insights(foundational_rows: DataFrame, advanced_rows: DataFrame) -> DataFrame:
    return ranked(union([foundational_rows, advanced_rows]), KEY_INSIGHTS)


# Detectors in the order their charts are proposed.
CHART_ORDER = ("correlation", "trend", "categorical", "distribution")


def recommended_charts(df: DataFrame, foundational_rows: DataFrame) -> DataFrame:
    """(position, chart_type, chart_columns): one per distinct chart of I1-I4, defaults where
    there is none, a KPI first and a heatmap last; at most six.

    Works on at most nine finding rows, which is why one window orders them.
    """
    spark = df.sparkSession
    numeric, categories = numeric_columns(df), categorical_columns(df)
    kind_order = F.array_position(F.array(*[F.lit(k) for k in CHART_ORDER]), F.col("kind"))
    in_order = Window.partitionBy(F.lit(0)).orderBy(kind_order, F.desc("priority_score"), F.desc("score"), "title")
    same_chart = Window.partitionBy("chart_type", "chart_columns").orderBy("place")
    proposed = (
        foundational_rows.withColumn("place", F.row_number().over(in_order))
        .withColumn("copy", F.row_number().over(same_chart))
        .where(F.col("copy") == 1)
        .select("place", "chart_type", "chart_columns")
    )
    default_rows = []
    if numeric:
        default_rows.append((1, "histogram", [numeric[0]]))
    if categories:
        default_rows.append((2, "bar", [categories[0]]))
    defaults = spark.createDataFrame(default_rows, "place int, chart_type string, chart_columns array<string>")
    has_findings = foundational_rows.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    extra = []
    if numeric:
        extra.append((0, "kpi", [numeric[0]]))
    if len(categories) >= 2:
        extra.append((1000, "heatmap", categories[:2]))
    extras = spark.createDataFrame(extra, "place int, chart_type string, chart_columns array<string>")
    charts = proposed.unionByName(defaults.where(~has_findings)).unionByName(extras)
    order = Window.partitionBy(F.lit(0)).orderBy("place")
    return charts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= RECOMMENDATIONS).select(
        F.col("position").cast("long").alias("position"), "chart_type", "chart_columns"
    )


def takeaways(insights: DataFrame, alerts: DataFrame) -> DataFrame:
    """The first quality alert and the three best insights as text rows, at most four."""
    note = alerts.where(F.col("alert") == 1).select(
        F.lit(0).alias("place"),
        F.concat(F.lit("Data quality note: "), "title", F.lit(" - "), "detail").alias("text"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.desc("priority_score"), F.desc("confidence_score"), F.desc("score"), "kind", "title"
    )
    best = (
        insights.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= TAKEAWAY_INSIGHTS)
        .select(
            "place",
            F.concat("title", F.lit(" ("), "confidence_label", F.lit(" confidence): "), "detail").alias("text"),
        )
    )
    return note.unionByName(best).orderBy("place").limit(TAKEAWAYS)


@dataclass(frozen=True)
class Summary:
    overview: DataFrame
    quality_alerts: DataFrame
    key_insights: DataFrame
    recommended_charts: DataFrame
    semantics: DataFrame
    model: DataFrame
    takeaways: DataFrame


def analyse(
    df: DataFrame,
    overrides: Mapping[str, Mapping] | None = None,
    with_model: bool = True,
    trees: int = drivers.TREES,
    approximate: bool = False,
) -> Summary:
    """Everything the summary shows for one prepared table, as small DataFrames, written out so that nothing stays cached.

    ``approximate`` takes distinct counts from sketches instead of a shuffle of all values.
    """
    semantics = checkpointed(infer_semantics(df, overrides, approximate))
    roles = roles_of(semantics)
    base = checkpointed(foundational.foundational(df, roles.averaged))
    insights = checkpointed(key_insights(base, advanced_insights(df, roles, with_model, trees)))
    facts = checkpointed(overview(df))
    alerts = quality_alerts(df, facts)
    return Summary(
        overview=facts,
        quality_alerts=alerts,
        key_insights=insights,
        recommended_charts=recommended_charts(df, base),
        semantics=semantics,
        model=dataset_model(semantics, facts.select("rows").scalar()),
        takeaways=takeaways(insights, alerts),
    )
