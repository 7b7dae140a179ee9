"""I16: confidence, label and priority of a finding, as column expressions.

Fixed values: full marks at 80 rows (35 points), effect 2.0 (35 points), p = 0 against a
ceiling of 0.2 (30 points) or stability 1 (20 points); labels from 80 and 60.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtally.functions.rounding import nearest

FINDING_FIELDS = (
    "kind", "title", "detail", "score", "stat", "chart_type", "chart_columns",
    "sample_size", "effect_size", "p_value",
    "confidence_score", "confidence_label", "priority_score", "why",
)


def confidence(sample: Column, effect: Column, p_value: Column, stability: Column) -> Column:
    sample_points = F.least(F.greatest(sample, F.lit(0)) / 80, F.lit(1.0)) * 35
    effect_points = F.least(F.abs(effect), F.lit(2.0)) / 2.0 * 35
    p_points = F.greatest(F.lit(0.0), 1 - F.least(p_value, F.lit(0.2)) / 0.2) * 30
    stable_points = F.least(F.greatest(stability, F.lit(0.0)), F.lit(1.0)) * 20
    has_p = p_value.isNotNull() & ~F.isnan(p_value)
    signal = F.when(has_p, p_points).when(stability.isNotNull(), stable_points).otherwise(F.lit(0.0))
    return nearest(F.least(F.lit(99.0), sample_points + effect_points + signal), 1)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def priority(score: Column, confidence_: Column) -> Column:
    return nearest(F.log1p(F.abs(score)) * F.greatest(confidence_ / 20, F.lit(1.0)), 3)


def enrich(findings: DataFrame) -> DataFrame:
    """Raw findings (with ``effect``, ``p``, ``stability``) to the common insight columns."""
    scored = findings.withColumn(
        "confidence_score", confidence(F.col("sample_size"), F.col("effect"), F.col("p"), F.col("stability"))
    )
    return scored.select(
        "kind",
        "title",
        "detail",
        "score",
        "stat",
        "chart_type",
        "chart_columns",
        F.col("sample_size").cast("long").alias("sample_size"),
        nearest(F.col("effect").cast("double"), 4).alias("effect_size"),
        F.when(~F.isnan("p"), nearest(F.col("p"), 6)).alias("p_value"),
        "confidence_score",
        confidence_label(F.col("confidence_score")).alias("confidence_label"),
        priority(F.col("score"), F.col("confidence_score")).alias("priority_score"),
        "why",
    )


def strongest(findings: DataFrame, limit: int) -> DataFrame:
    """The detector's own top findings; ties are settled by title."""
    return findings.orderBy(F.desc("priority_score"), F.desc("score"), "title").limit(limit)
