"""Replayable single-table transforms (T1-T6). Each is DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import col, moment, number, numeric_columns, present
from prismtally.functions.parsing import strip
from prismtally.functions.quantiles import quantile_row
from prismtally.operators.filters import keep_columns

SPARSE_DEFAULT = 40.0


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def trim_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[strip(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields]
    )


def fill_numeric_median(df: DataFrame) -> DataFrame:
    """Medians only of the columns that have gaps, all from one exact selection; the fill is lazy."""
    numeric = numeric_columns(df)
    if not numeric:
        return df
    gaps = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(numeric)]).first()
    gappy = [c for i, c in enumerate(numeric) if gaps[i]]
    medians = quantile_row(df, {c: number(df, c) for c in gappy}, [0.5])
    out = []
    for f in df.schema.fields:
        median = medians.get(f.name)
        if median is None:
            out.append(col(f.name))
            continue
        # A whole-number column stays whole only when its median is.
        whole = isinstance(f.dataType, T.IntegralType) and float(median[0]).is_integer()
        base = present(df, f.name) if whole else number(df, f.name)
        fill = F.lit(int(median[0])).cast(f.dataType) if whole else F.lit(float(median[0]))
        out.append(F.coalesce(base, fill).alias(f.name))
    return df.select(*out)


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_DEFAULT) -> DataFrame:
    """Drop the columns whose share of missing values is above ``threshold`` percent."""
    row = df.agg(
        *[(F.avg(present(df, c).isNull().cast("int")) * 100).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if row[i] is not None and row[i] <= threshold])


DATE_PARTS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "month_name": lambda when: F.date_format(when, "MMMM"),
}


def create_date_parts(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"There is no column {column!r} to take dates from.")
    when = moment(df, column)
    if df.where(when.isNotNull()).isEmpty():
        raise ValueError(f"No value of {column!r} reads as a date.")
    return df.withColumns({f"{prefix or column}_{part}": cut(when) for part, cut in DATE_PARTS.items()})


# Doubles follow IEEE rules and do not raise; only division needs its zero guarded.
OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": F.try_divide,
}


def _operand(df: DataFrame, value, mode: str) -> Column:
    """A column by name or a constant, as doubles."""
    if mode != "column":
        return F.lit(float(value))
    if value not in df.columns:
        raise KeyError(value)
    return number(df, value)


def create_calculated_column(
    df: DataFrame, new_column: str, left: str, operator: str, right_value, right_mode: str = "column"
) -> DataFrame:
    """``left operator right`` as a new column, the right side being a column or a constant."""
    name = (new_column or "").strip()
    try:
        combine = OPERATORS[operator]
        value = combine(_operand(df, left, "column"), _operand(df, right_value, right_mode))
    except KeyError as unknown:
        raise ValueError(f"{unknown.args[0]!r} is neither a column of the dataset nor one of {' '.join(OPERATORS)}.") from None
    except (TypeError, ValueError):
        raise ValueError(f"The constant {right_value!r} is not a number.") from None
    if not name:
        raise ValueError("The new column needs a name.")
    return df.withColumn(name, value)


# Operation names of the persisted steps and the options each one takes.
STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "drop_duplicates": lambda df, o: drop_duplicates(df),
    "trim_text": lambda df, o: trim_text(df),
    "fill_numeric_median": lambda df, o: fill_numeric_median(df),
    "drop_sparse_columns": lambda df, o: drop_sparse_columns(df, float(o.get("threshold", SPARSE_DEFAULT))),
    "keep_columns": lambda df, o: keep_columns(df, o.get("columns") or []),
    "create_date_parts": lambda df, o: create_date_parts(df, o.get("column"), o.get("prefix")),
    "create_calculated_column": lambda df, o: create_calculated_column(
        df, o.get("new_column"), o.get("left"), o.get("operator"), o.get("right_value"), o.get("right_mode", "column")
    ),
}


def apply_transform(df: DataFrame, operation: str, options: dict | None = None) -> DataFrame:
    if operation not in STEPS:
        raise ValueError(f"{operation!r} is none of the transforms {', '.join(STEPS)}.")
    return STEPS[operation](df, options or {})


def transform_report(before: DataFrame, after: DataFrame, operation: str) -> DataFrame:
    """What a step did, as one row: rows and columns before and after, rows removed, columns added and dropped, cells filled.

    One aggregate per side; the cells are those missing before and present after in the columns that both have.
    """
    shared = [c for c in before.columns if c in after.columns]

    def totals(df: DataFrame) -> DataFrame:
        missing = sum((F.count_if(present(df, c).isNull()) for c in shared), F.lit(0))
        return df.agg(F.count(F.lit(1)).alias("rows"), missing.cast("long").alias("missing"))

    old, new = totals(before), totals(after)
    names = lambda some: F.array(*map(F.lit, some)).cast("array<string>")
    rows = new.select(F.lit(operation).alias("operation"), old.select("rows").scalar().alias("rows_before"), F.col("rows").alias("rows_after"), F.col("missing"), old.select("missing").scalar().alias("was"))
    removed = F.col("rows_before") - F.col("rows_after")
    return rows.select(
        "operation",
        "rows_before",
        "rows_after",
        removed.alias("rows_removed"),
        names([c for c in after.columns if c not in before.columns]).alias("columns_added"),
        names([c for c in before.columns if c not in after.columns]).alias("columns_dropped"),
        F.when(removed == 0, F.col("was") - F.col("missing")).otherwise(0).alias("cells_filled"),
    )
