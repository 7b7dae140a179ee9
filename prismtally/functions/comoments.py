"""Co-moments of many columns at once, over the rows where both columns of a pair are present.

A task folds its batches of rows into a few square matrices, one entry per ordered pair of columns (a, b): how many rows have both, and over
those rows the mean of a, its squared deviations, and the co-deviation of a with b. A batch gives them by four matrix products of the
shifted values and the marks of what is present, so a further column costs no further expression in the plan, and a missing
value in one column leaves the other pairs alone. Partial results merge by the pairwise update of means and deviations, which
does not cancel however large the mean is; a task sends one row, rows of many tasks meet in a tree.

A pair whose deviations come out small against the shifted squares is taken again from its own rows around their first value, so a column that
does not vary where the other is present has deviations of exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANCELLED = 1e-9  # deviations below this share of the shifted squares have lost too many digits
TREE = 256  # rows that reach the driver at most; a merging task gets the rows of one task in so many
MATRICES = ("n", "mean", "square", "cross", "odd")
SCHEMA = ", ".join(f"{m} array<double>" for m in MATRICES)


@dataclass
class CoMoments:
    """Entry (a, b) of each matrix is about column a over the rows where a and b are present; ``odd`` counts the further
    rows in which one of them is infinite."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray
    odd: np.ndarray

    @classmethod
    def empty(cls, columns: int) -> CoMoments:
        return cls(*[np.zeros((columns, columns)) for _ in MATRICES])

    @classmethod
    def of(cls, values: np.ndarray) -> CoMoments:
        """Of a batch (rows x columns), NaN where a value is missing."""
        present = ~np.isnan(values)
        infinite = np.isinf(values)
        usable = present & ~infinite
        marks = usable.astype(np.float64)
        counts = usable.sum(axis=0)
        shift = np.divide(np.where(usable, values, 0.0).sum(axis=0), counts, out=np.zeros(values.shape[1]), where=counts > 0)
        shift[~np.isfinite(shift)] = 0.0
        x = np.where(usable, values - shift, 0.0)
        with np.errstate(all="ignore"):
            n, sums, squares, products = marks.T @ marks, x.T @ marks, (x * x).T @ marks, x.T @ x
            some = np.maximum(n, 1)
            out = cls(n, shift[:, None] + sums / some, squares - sums * sums / some, products - sums * sums.T / some, np.zeros_like(n))
            out.mean[n == 0] = 0.0
            doubtful = (n > 0) & ~(out.square > CANCELLED * squares)
        for a, b in np.argwhere(doubtful | doubtful.T):
            out._again(values, usable, a, b)
        both = present.astype(np.float64)
        infinities = infinite.astype(np.float64)
        one = infinities.T @ both
        out.odd = one + one.T - infinities.T @ infinities
        return out

    def _again(self, values: np.ndarray, usable: np.ndarray, a: int, b: int) -> None:
        rows = usable[:, a] & usable[:, b]
        left, right = values[rows, a], values[rows, b]
        with np.errstate(all="ignore"):
            from_first, other = left - left[0], right - right[0]
            shift = from_first.mean()
            around, across = from_first - shift, other - other.mean()
            if not from_first.any():
                around = from_first
            self.mean[a, b] = left[0] + shift
            self.square[a, b] = around @ around
            self.cross[a, b] = around @ across

    def add(self, more: CoMoments) -> None:
        with np.errstate(all="ignore"):
            total = self.n + more.n
            some = np.maximum(total, 1)
            apart = np.where((self.n > 0) & (more.n > 0), more.mean - self.mean, 0.0)
            weight = self.n * more.n / some
            self.square += more.square + apart * apart * weight
            self.cross += more.cross + apart * apart.T * weight
            self.mean = np.where(self.n == 0, more.mean, self.mean + apart * (more.n / some))
        self.n = total
        self.odd += more.odd

    @classmethod
    def read(cls, row: dict, columns: int) -> CoMoments:
        return cls(*[np.array(row[m], np.float64).reshape(columns, columns) for m in MATRICES])

    def written(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(self, m).ravel()], pa.list_(pa.float64())) for m in MATRICES], names=list(MATRICES))

    def correlations(self) -> np.ndarray:
        """NaN where a column holds an infinity or a pair has no rows, 2 where a column does not vary."""
        with np.errstate(all="ignore"):
            r = self.cross / (np.sqrt(self.square) * np.sqrt(self.square.T))
        r = np.where((self.square <= 0) | (self.square.T <= 0), 2.0, np.clip(r, -1.0, 1.0))
        return np.where(self.odd > 0, np.nan, r)


def co_moments(df: DataFrame, values: list[Column]) -> CoMoments:
    """Of all rows of ``df``; NaN counts as missing. Only the matrices (one row) reach the driver."""
    columns = len(values)
    if not columns:
        return CoMoments.empty(0)
    rows = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                part = CoMoments.of(table.astype(np.float64))
                if total is None:
                    total = part
                else:
                    total.add(part)
        if total is not None:
            yield total.written()

    def merge(parts: pa.Table) -> pa.Table:
        total = CoMoments.empty(columns)
        for row in parts.select(list(MATRICES)).to_pylist():
            total.add(CoMoments.read(row, columns))
        return pa.Table.from_batches([total.written()])

    folded = rows.mapInArrow(fold, SCHEMA)
    branch = F.pmod(F.spark_partition_id(), F.lit(TREE)).alias("branch")
    merged = folded.withColumn("branch", branch).groupBy("branch").applyInArrow(merge, SCHEMA)
    total = CoMoments.empty(columns)
    for row in merged.collect():  # TREE rows at most
        total.add(CoMoments.read(row.asDict(), columns))
    return total
