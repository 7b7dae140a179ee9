"""Declarative business measures (B1-B7): a definition in, one row (per group) out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import col, moment, number, period_start

GRAINS = {"M": "month", "Q": "quarter", "Y": "year"}
STEPS = ("day", "week", "month", "quarter", "year")
DEFAULT_WINDOW = 7


def _needed(df: DataFrame, column: str | None, what: str = "Column") -> str:
    if not column or column not in df.columns:
        raise ValueError(f"{what} {column!r} is not in the dataset.")
    return column


def _total(df: DataFrame, column: str | None) -> Column:
    # A sum over no values is 0, as for an empty column.
    return F.coalesce(F.sum(number(df, _needed(df, column))), F.lit(0.0))


def _change(last: Column, first: Column) -> Column:
    return F.try_divide(last - first, F.abs(first)) * 100


def _ratio(df: DataFrame, d: dict) -> Column:
    return F.try_divide(_total(df, d.get("numerator")), _total(df, d.get("denominator")))


def _margin(df: DataFrame, d: dict) -> Column:
    revenue = _total(df, d.get("revenue"))
    return F.try_divide(revenue - _total(df, d.get("cost")), revenue) * 100


def _conversion(df: DataFrame, d: dict) -> Column:
    return F.try_divide(_total(df, d.get("converted")), _total(df, d.get("total"))) * 100


# Measures that are plain ratios of sums: any number of them share one scan.
SUM_MEASURES: dict[str, Callable[[DataFrame, dict], Column]] = {
    "ratio": _ratio,
    "margin": _margin,
    "conversion_rate": _conversion,
}


def shown(value: Column) -> Column:
    """Four decimals; not-finite values become null."""
    return F.round(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value), 4)


def evaluate_sum_measures(df: DataFrame, definitions: list[dict], by: list[str] | None = None) -> DataFrame:
    """Several ratio-of-sums measures in one aggregate, one column per measure name."""
    by = by or []
    aggs = [shown(SUM_MEASURES[d["type"]](df, d)).alias(d.get("name") or d["type"]) for d in definitions]
    return df.groupBy(*[col(c) for c in by]).agg(*aggs)


def period_totals(df: DataFrame, d: dict, by: list[str], unit: str | None) -> DataFrame:
    """Totals of the metric per timestamp or calendar unit; equal timestamps collapse map-side."""
    when = moment(df, _needed(df, d.get("date_column"), "Date column"))
    period = period_start(when, unit) if unit else when
    rows = df.select(*[col(c) for c in by], period.alias("period"), number(df, _needed(df, d.get("metric"))).alias("value"))
    return rows.where(F.col("period").isNotNull() & F.col("value").isNotNull()).groupBy(*by, "period").agg(
        F.sum("value").alias("total")
    )


def _growth(df: DataFrame, d: dict, by: list[str]) -> DataFrame:
    totals = period_totals(df, d, by, None)
    return totals.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"),
        _change(F.max_by("total", "period"), F.min_by("total", "period")).alias("raw"),
    )


def _latest(totals: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` latest periods (of each group), newest first in ``age``.

    Without groups this is a bounded top-k; with groups the rank filter is cut per task before
    the shuffle, so a long group never reaches one task whole.
    """
    if not by:
        newest = totals.orderBy(F.desc("period")).limit(k)
        return newest.withColumn("age", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("period"))))
    spec = Window.partitionBy(*by).orderBy(F.desc("period"))
    return totals.withColumn("age", F.row_number().over(spec)).where(F.col("age") <= k)


def _step(d: dict) -> str:
    """The unit of a rolling average, for its value and its series alike."""
    step = d.get("step") or "day"
    if step not in STEPS:
        raise ValueError(f"A rolling average has no step {step!r}; it goes by {', '.join(STEPS)}.")
    return step


def _rolling(df: DataFrame, d: dict, by: list[str]) -> DataFrame:
    window = int(d.get("window") or DEFAULT_WINDOW)
    newest = _latest(period_totals(df, d, by, _step(d)), by, window)
    return newest.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), F.avg("total").alias("raw"))


def _period_change(df: DataFrame, d: dict, by: list[str]) -> DataFrame:
    grain = d.get("grain") or "M"
    if grain not in GRAINS:
        raise ValueError(f"No grain {grain!r}: a change is measured by M, Q or Y.")
    pair = _latest(period_totals(df, d, by, GRAINS[grain]), by, 2)
    latest = F.max(F.when(F.col("age") == 1, F.col("total")))
    previous = F.max(F.when(F.col("age") == 2, F.col("total")))
    return pair.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), _change(latest, previous).alias("raw"))


# Measures over time: least number of periods, the error below it, and the evaluation.
TIME_MEASURES: dict[str, tuple[int, str, Callable[[DataFrame, dict, list[str]], DataFrame]]] = {
    "growth_pct": (2, "Growth needs the metric at two different times or more.", _growth),
    "rolling_average": (1, "There is no dated value to average.", _rolling),
    "period_change": (2, "A change needs two periods or more.", _period_change),
}


# How the value of each type comes about, filled in from its definition.
EXPLANATIONS: dict[str, str] = {
    "ratio": "sum of {numerator} over sum of {denominator}",
    "margin": "share of {revenue} left after {cost}, in percent",
    "conversion_rate": "sum of {converted} per hundred of {total}",
    "growth_pct": "{metric} at the last {date_column} against the first, in percent",
    "rolling_average": "mean {metric} of the last {window} {step}s by {date_column}",
    "period_change": "{metric} of the last {grain} by {date_column} against the one before, in percent",
}


def explain_measure(definition: dict) -> str:
    """One sentence that says what is computed from which columns."""
    filled = {"window": DEFAULT_WINDOW, "step": "day", **{k: v for k, v in definition.items() if v}}
    filled["grain"] = GRAINS.get(filled.get("grain", "M"), filled.get("grain"))
    return EXPLANATIONS[definition["type"]].format_map(filled)


def evaluate_measure(
    df: DataFrame, definition: dict, by: list[str] | None = None, strict: bool = False, explain: bool = False
) -> DataFrame:
    """(by..., name, type, value) and, if asked for, ``explanation``.

    ``strict`` raises where too few periods exist, at the price of one job ahead of the plan; otherwise such a value is null.
    """
    kind = definition.get("type")
    by = by or []
    if kind in SUM_MEASURES:
        table = df.groupBy(*[col(c) for c in by]).agg(SUM_MEASURES[kind](df, definition).alias("raw"))
    elif kind in TIME_MEASURES:
        least, message, run = TIME_MEASURES[kind]
        table = run(df, definition, by)
        if strict and not by:
            row = table.first()
            if row is None or row["periods"] < least:
                raise ValueError(message)
        table = table.withColumn("raw", F.when(F.col("periods") >= least, F.col("raw")))
    else:
        raise ValueError(f"{kind!r} is none of the measures {', '.join([*SUM_MEASURES, *TIME_MEASURES])}.")
    out = table.select(*by, F.lit(definition.get("name") or kind).alias("name"), F.lit(kind).alias("type"), shown(F.col("raw")).alias("value"))
    return out.withColumn("explanation", F.lit(explain_measure(definition))) if explain else out


def rolling_series(df: DataFrame, definition: dict, by: list[str]) -> DataFrame:
    """B5 as a full series: the moving average at every step (a day unless ``step`` says otherwise) of every group.

    After the aggregation a group has at most one row per calendar unit, which bounds each
    window partition however many rows fell on it.
    """
    window = int(definition.get("window") or DEFAULT_WINDOW)
    spec = Window.partitionBy(*by).orderBy("period").rowsBetween(-(window - 1), 0)
    return period_totals(df, definition, by, _step(definition)).withColumn("rolling", F.avg("total").over(spec))
