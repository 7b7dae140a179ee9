"""Sensitivity labels and quality risk over a whole catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Substrings of column names.
RESTRICTED = (
    "ssn", "social_security", "aadhaar", "passport", "credit_card", "card_number",
    "cvv", "iban", "swift", "routing", "tax_id", "pan_number",
)
CONFIDENTIAL = (
    "email", "phone", "mobile", "address", "full_name", "first_name", "last_name",
    "customer_name", "birth", "dob", "salary", "payroll", "compensation",
)
NUMERIC_TYPES = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
HIGH_RISK_WARNINGS = 3
SHOWN_HINTS = 4


def sensitivity_labels(schema: DataFrame) -> DataFrame:
    """(dataset, label, hints) from (dataset, column, dtype) rows.

    Restricted before Confidential before General (some numeric column) before Public. One flag
    per hint is aggregated, so a dataset with very many columns is still one small row per task.
    """
    name = F.lower("column")
    flags = schema.groupBy("dataset").agg(
        *[F.max(name.contains(h)).alias(f"hint_{h}") for h in (*RESTRICTED, *CONFIDENTIAL)],
        F.max(F.col("dtype").rlike(NUMERIC_TYPES)).alias("numeric"),
    )

    def found(hints: tuple[str, ...]):
        return F.array_compact(F.array(*[F.when(F.col(f"hint_{h}"), F.lit(h)) for h in sorted(hints)]))

    sets = flags.select(
        "dataset", found(RESTRICTED).alias("restricted"), found(CONFIDENTIAL).alias("confidential"), "numeric"
    )
    label = (
        F.when(F.size("restricted") > 0, "Restricted")
        .when(F.size("confidential") > 0, "Confidential")
        .when(F.col("numeric"), "General")
        .otherwise("Public")
    )
    hints = F.when(F.size("restricted") > 0, F.col("restricted")).otherwise(F.col("confidential"))
    return sets.select(
        "dataset", label.alias("label"), F.array_join(F.slice(hints, 1, SHOWN_HINTS), ", ").alias("hints")
    )


def quality_risk(alerts: DataFrame, by: str = "dataset") -> DataFrame:
    """High from three warnings on, Medium from one, else Low; ``alerts`` has a severity per row."""
    warnings = F.count_if(F.col("severity") == "warning")
    risk = F.when(warnings >= HIGH_RISK_WARNINGS, "High").when(warnings >= 1, "Medium").otherwise("Low")
    return alerts.groupBy(by).agg(warnings.alias("warnings"), risk.alias("quality_risk"))
