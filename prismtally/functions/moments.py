"""Moments of many columns at once: one scan, one row per task, whatever the number of columns.

A wide table of aggregate expressions falls off the just-in-time compiler long before it has too many columns to read. Here a task
folds its batches column by column into a few numbers (count, mean, second to fourth central sums, extremes, values outside two fences, sum),
which merge pairwise without cancelling; sums are taken around the first value of a batch, so a column that does not vary has central sums of exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("n", "mean", "m2", "m3", "m4", "low", "high", "outside", "total")
SCHEMA = ", ".join(f"{f} array<double>" for f in FIELDS)
TREE = 256  # rows that reach the driver at most; a merging task gets the rows of one task in so many
N, MEAN, M2, M3, M4, LOW, HIGH, OUTSIDE, TOTAL = range(len(FIELDS))


def empty(columns: int) -> np.ndarray:
    out = np.zeros((len(FIELDS), columns))
    out[LOW], out[HIGH] = np.inf, -np.inf
    return out


def of_values(x: np.ndarray, fence: tuple[float, float] | None) -> np.ndarray:
    """The fields of one column of a batch; ``x`` has no missing values."""
    out = empty(1)[:, 0]
    if not len(x):
        return out
    out[N], out[LOW], out[HIGH], out[TOTAL] = len(x), x.min(), x.max(), x.sum()
    if fence is not None:
        out[OUTSIDE] = np.count_nonzero((x < fence[0]) | (x > fence[1]))
    if not np.isfinite(x).all():
        out[MEAN], out[M2:LOW] = x.mean(), np.nan
        return out
    d = x - x[0]
    shift = d.mean()
    out[MEAN] = x[0] + shift
    d -= shift
    square = d * d
    out[M2], out[M3], out[M4] = square.sum(), (square * d).sum(), (square * square).sum()
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fields of two disjoint sets of rows taken together, for all columns."""
    out = np.where(a[N] == 0, b, a)
    both = (a[N] > 0) & (b[N] > 0)
    a, b = a[:, both], b[:, both]
    n, share = a[N] + b[N], b[N] / (a[N] + b[N])
    d = b[MEAN] - a[MEAN]
    p = a[N] * share  # n_a * n_b / n
    c = np.empty_like(a)
    c[N] = n
    c[MEAN] = np.where(np.isfinite(d), a[MEAN] + d * share, (a[N] * a[MEAN] + b[N] * b[MEAN]) / n)
    c[M2] = a[M2] + b[M2] + d * d * p
    c[M3] = a[M3] + b[M3] + d**3 * p * (a[N] - b[N]) / n + 3 * d * (a[N] * b[M2] - b[N] * a[M2]) / n
    c[M4] = (
        a[M4] + b[M4] + d**4 * p * (a[N] ** 2 - a[N] * b[N] + b[N] ** 2) / n**2
        + 6 * d * d * (a[N] ** 2 * b[M2] + b[N] ** 2 * a[M2]) / n**2 + 4 * d * (a[N] * b[M3] - b[N] * a[M3]) / n
    )
    c[LOW], c[HIGH], c[OUTSIDE], c[TOTAL] = np.minimum(a[LOW], b[LOW]), np.maximum(a[HIGH], b[HIGH]), a[OUTSIDE] + b[OUTSIDE], a[TOTAL] + b[TOTAL]
    out[:, both] = c
    return out


def _row(fields: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fields[k]], pa.list_(pa.float64())) for k in range(len(FIELDS))], names=list(FIELDS))


def column_moments(df: DataFrame, values: list[Column], fences: list[tuple[float, float] | None]) -> np.ndarray:
    """``FIELDS`` x columns over all rows; nulls and NaN are missing. ``fences`` bound what counts as outside, column by column."""
    columns = len(values)
    if not columns:
        return empty(0)
    rows = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty(columns)
        with np.errstate(all="ignore"):
            for batch in batches:
                part = []
                for column, fence in zip(batch.columns, fences, strict=True):
                    x = column.to_numpy(zero_copy_only=False)
                    part.append(of_values(x[~np.isnan(x)], fence))
                total = merged(total, np.column_stack(part))
        yield _row(total)

    def merge(parts: pa.Table) -> pa.Table:
        total = empty(columns)
        with np.errstate(all="ignore"):
            for row in parts.select(list(FIELDS)).to_pylist():
                total = merged(total, np.array([row[f] for f in FIELDS]))
        return pa.Table.from_batches([_row(total)])

    branch = F.pmod(F.spark_partition_id(), F.lit(TREE)).alias("branch")
    parts = rows.mapInArrow(fold, SCHEMA).withColumn("branch", branch).groupBy("branch").applyInArrow(merge, SCHEMA).collect()  # TREE rows at most
    total = empty(columns)
    with np.errstate(all="ignore"):
        for row in parts:
            total = merged(total, np.array([row[f] for f in FIELDS]))
    return total
