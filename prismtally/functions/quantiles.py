"""Exact quantiles (linear interpolation) without gathering a group in one task.

Whole columns are read twice, however many there are. The first scan keeps a mergeable rank sketch per column (KLL), whose error bound
turns each wanted rank into a narrow bracket of values. The second scan counts what lies below a bracket and at its two ends and
keeps the values inside, which are a fraction of the column that the bound fixes; a hot value cannot lie inside, as it would fill
the bracket, so it is counted at an end. The wanted ranks are then selected from the kept values alone. The counts prove that a rank
is in its bracket; should one ever not be, its column is selected by histogram passes over all values.

A selection pass counts the values of every open bracket into buckets (map-side combined), keeps the bucket that holds the wanted rank and
narrows the bracket to that bucket's smallest and largest value. Once the open brackets hold few values, every distinct value is
a bucket of its own, which ends the search. Brackets are a few numbers and enter each pass as literals.

Groups take the built-in ``percentile`` while the values are few enough for its buffers, and the same selection, with the
brackets as a checkpointed table joined on the group, beyond that. Both give the same answer, infinite values included; the
bound only chooses the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.session import checkpointed, scratch_path

EXACT_VALUES_KEY = "spark.prismtally.quantiles.builtinValues"
EXACT_VALUES_DEFAULT = 5_000_000
COUNTERS, FEWEST_BUCKETS, MOST_BUCKETS = 1_000_000, 512, 65_536
BROADCAST_BRACKETS = 20_000
COLUMNS_PER_PASS = 24
LARGEST = 1.7976931348623157e308
SKETCH_SIZE = 4096
# Twice the sketch's error at 99 % confidence, and the difference between p * (n - 1) and p * n in a long column.
SKETCH_MARGIN = 2 * 2.296 / SKETCH_SIZE**0.9021 + 2e-4
SHORT_COLUMN = 10_000  # so many values are kept whole
BIN_SLACK = 1 / 16
KEPT_VALUES = 4_000_000  # of a task, until it hands them on


def builtin_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(EXACT_VALUES_KEY, str(EXACT_VALUES_DEFAULT)))


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: list[float],
    by: list[str] | None = None,
    weight: Column | None = None,
    builtin_values: int | None = None,
) -> DataFrame:
    """One row per group with an ``array<double>`` column per entry of ``values``.

    ``weight`` gives each value a whole-number frequency. Nulls are skipped; a group without
    values gets a null array. ``builtin_values`` is the number of grouped values up to which the built-in aggregate is used.
    """
    by = by or []
    row_weight = weight if weight is not None else F.lit(1)
    picked = df.select(
        *by, *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())], row_weight.cast("long").alias("w")
    )
    most = builtin_limit(df) if builtin_values is None else builtin_values
    if by and picked.count() * max(len(values), 1) <= most:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        aggs = []
        for i, name in enumerate(values):
            arr = F.percentile(F.col(f"v{i}"), probs, F.col("w")) if weight is not None else F.percentile(F.col(f"v{i}"), probs)
            aggs.append(arr.alias(name))
        return picked.groupBy(*by).agg(*aggs)
    if by:
        return _selected(picked, list(values), probabilities, by)
    names = list(values)
    found: dict[str, list[float] | None] = {}
    select = _by_histogram if weight is not None else _by_sketch
    for at in range(0, len(names), COLUMNS_PER_PASS):
        series = range(at, min(at + COLUMNS_PER_PASS, len(names)))
        for i, q in select(picked, series, probabilities).items():
            found[names[i]] = q
    schema = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in names])
    return df.sparkSession.createDataFrame([tuple(found[n] for n in names)], schema)


@dataclass(frozen=True)
class Bracket:
    """Ranks of one series whose values lie in [lo, hi], with the number of values below and inside."""

    series: int
    lo: float
    hi: float
    below: int
    held: int
    ranks: tuple[int, ...]


def _ranks(n: int, probabilities: list[float]) -> list[int]:
    return sorted({f(p * (n - 1)) for p in probabilities for f in (math.floor, math.ceil)}) if n else []


def _interpolated(n: int, probabilities: list[float], at_rank: dict[int, float]) -> list[float] | None:
    def quantile(p: float) -> float:
        at = p * (n - 1)
        low, high = at_rank[math.floor(at)], at_rank[math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return [quantile(p) for p in probabilities] if n else None


def _number(i: int) -> Column:
    """Series ``i`` with NaN as the largest value, as Spark orders it."""
    return F.when(F.isnan(f"v{i}"), math.inf).otherwise(F.col(f"v{i}"))


def _by_sketch(picked: DataFrame, series: range, probabilities: list[float]) -> dict[int, list[float] | None]:
    """Quantiles of whole columns from two scans."""
    cuts = [min(1.0, max(0.0, c)) for p in probabilities for c in (p - SKETCH_MARGIN, p + SKETCH_MARGIN)]
    grid = F.array(*[F.lit(float(c)) for c in [*cuts, 0.0, 1.0]])
    sketches = picked.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in series],
        *[F.kll_sketch_agg_double(_number(i), F.lit(SKETCH_SIZE)).alias(f"s{i}") for i in series],
    )
    row = sketches.select(*[f"n{i}" for i in series], *[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", grid)).alias(f"q{i}") for i in series]).first()
    sizes = {i: row[f"n{i}"] for i in series}
    wanted: list[Bracket] = []
    for i in series:
        edges, n = row[f"q{i}"], sizes[i]
        if n and n <= SHORT_COLUMN or n and edges[-2] == edges[-1]:
            wanted.append(Bracket(i, edges[-2], edges[-1], 0, n, tuple(_ranks(n, probabilities))))
        elif n:
            wanted += [Bracket(i, edges[2 * k], edges[2 * k + 1], 0, n, tuple(_ranks(n, [p]))) for k, p in enumerate(probabilities)]

    found: dict[tuple[int, int], float] = {}
    inside: list[Bracket] = []
    missed: set[int] = set()
    if wanted:
        held = _held(picked, wanted)
        totals = held.agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in range(len(wanted)) for c in ("below", "to_lo", "to_hi")], *[F.sum(F.size(f"inner{k}")).alias(f"inner{k}") for k in range(len(wanted))]).first()
        for k, b in enumerate(wanted):
            below, to_lo, to_hi, inner = (totals[f"{c}{k}"] for c in ("below", "to_lo", "to_hi", "inner"))
            between = []
            for r in b.ranks:
                if r < below or r >= to_hi:
                    missed.add(b.series)
                elif r < to_lo:
                    found[b.series, r] = b.lo
                elif r >= to_lo + inner:
                    found[b.series, r] = b.hi
                else:
                    between.append(r)
            if between:
                inside.append(Bracket(k, b.lo, b.hi, to_lo, inner, tuple(between)))
        if inside:
            kept = F.explode(F.array(*[F.struct(F.lit(b.series).alias("k"), F.col(f"inner{b.series}").alias("inner")) for b in inside]))
            long = held.select(kept.alias("e")).select("e.k", F.explode("e.inner").alias("v"), F.lit(1).cast("long").alias("w"))
            for (k, r), v in _narrowed(long, inside).items():
                found[wanted[k].series, r] = v
    out = {i: _interpolated(sizes[i], probabilities, {r: v for (s, r), v in found.items() if s == i}) for i in series if i not in missed}
    for i in missed:
        out |= _by_histogram(picked, range(i, i + 1), probabilities)
    return out


def _held(picked: DataFrame, wanted: list[Bracket]) -> DataFrame:
    """Per task and bracket: how many values lie below it, up to its lower and its upper end, and the values between.

    A task keeps the values inside the brackets only, and hands them on when they are many.
    """
    names = [f"{c}{k}" for k in range(len(wanted)) for c in ("below", "to_lo", "to_hi", "inner")]
    schema = ", ".join(f"{n} array<double>" if n.startswith("inner") else f"{n} long" for n in names)
    series = sorted({b.series for b in wanted})

    def row(counts: np.ndarray, inner: list[list[np.ndarray]]) -> pa.RecordBatch:
        arrays = []
        for k in range(len(wanted)):
            arrays += [pa.array([int(c)], pa.int64()) for c in counts[k]]
            arrays.append(pa.array([np.concatenate(inner[k])] if inner[k] else [[]], pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, inner, kept = np.zeros((len(wanted), 3), np.int64), [[] for _ in wanted], 0
        for batch in batches:
            values = {}
            for i, column in zip(series, batch.columns, strict=True):
                column = column.drop_null().to_numpy(zero_copy_only=False)
                values[i] = np.where(np.isnan(column), np.inf, column)
            for k, b in enumerate(wanted):
                v = values[b.series]
                counts[k] += np.count_nonzero(v < b.lo), np.count_nonzero(v <= b.lo), np.count_nonzero(v <= b.hi)
                between = v[(v > b.lo) & (v < b.hi)]
                if len(between):
                    inner[k].append(between)
                    kept += len(between)
            if kept > KEPT_VALUES:
                yield row(counts, inner)
                counts, inner, kept = np.zeros_like(counts), [[] for _ in wanted], 0
        yield row(counts, inner)

    path = scratch_path(picked.sparkSession, "ranks")
    picked.select(*[f"v{i}" for i in series]).mapInArrow(run, schema).write.parquet(path)
    return picked.sparkSession.read.parquet(path)


def _series(picked: DataFrame, series: range) -> tuple[DataFrame, dict[int, Row]]:
    """Rows ``k`` (series), ``v``, ``w`` of the columns, and per series how many values it has (``n``), its smallest and its largest."""
    entries = F.array(*[F.struct(F.lit(i).alias("k"), _number(i).alias("v")) for i in series])
    long = picked.where(F.col("w") > 0).select(F.explode(entries).alias("e"), "w").select("e.k", "e.v", "w").where(F.col("v").isNotNull())
    return long, {r["k"]: r for r in long.groupBy("k").agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}


def _by_histogram(picked: DataFrame, series: range, probabilities: list[float]) -> dict[int, list[float] | None]:
    """Quantiles of whole columns with frequencies, by selection passes alone."""
    long, sizes = _series(picked, series)
    found = _narrowed(long, [Bracket(i, r["lo"], r["hi"], 0, r["n"], tuple(_ranks(r["n"], probabilities))) for i, r in sizes.items()])
    n = {i: sizes[i]["n"] if i in sizes else 0 for i in series}
    return {i: _interpolated(n[i], probabilities, {r: v for (s, r), v in found.items() if s == i}) for i in series}


def _narrowed(long: DataFrame, brackets: list[Bracket], slack: dict[int, int] | None = None) -> dict[tuple[int, int], float]:
    """The values at the ranks of the brackets, one bracket per series to begin with, from rows ``k`` (series), ``v``, ``w``.

    Only the chosen buckets of each pass (a few rows) are collected. A bracket that holds no more values than the ``slack`` of its series
    is narrow enough: its ranks get its upper end.
    """
    found: dict[tuple[int, int], float] = {}
    slack = slack or {}
    while True:
        done = [b for b in brackets if b.lo == b.hi or b.held <= slack.get(b.series, 0)]
        found.update({(b.series, r): b.hi for b in done for r in b.ranks})
        brackets = [b for b in brackets if b not in done]
        if not brackets:
            return found
        by_value = sum(b.held for b in brackets) <= builtin_limit(long)
        buckets = max(FEWEST_BUCKETS, min(MOST_BUCKETS, COUNTERS // len(brackets)))
        entries = []
        clipped = lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))
        for j, b in enumerate(brackets):
            v = F.col("v")
            lo, hi = max(b.lo, -LARGEST), min(b.hi, LARGEST)
            if by_value or hi / 2 - lo / 2 <= 0:
                bucket = v
            else:
                share = (clipped(v) / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
                bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("double")
            entry = F.struct(F.lit(j).alias("j"), bucket.alias("bucket"), v.alias("v"))
            entries.append(F.when((F.col("k") == b.series) & v.between(b.lo, b.hi), entry))
        wanted = F.array(*[F.array(*[F.lit(r - b.below).cast("long") for r in b.ranks]) for b in brackets])
        chosen = F.exists(F.element_at(wanted, F.col("j") + 1), lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")))
        counted = (
            long.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), "w")
            .groupBy("e.j", "e.bucket")
            .agg(F.sum("w").alias("c"), F.min("e.v").alias("lo"), F.max("e.v").alias("hi"))
        )
        running = F.sum("c").over(Window.partitionBy("j").orderBy("bucket"))
        before, brackets = brackets, []
        for row in counted.withColumn("upto", running).where(chosen).collect():
            b = before[row["j"]]
            below = b.below + row["upto"] - row["c"]
            ranks = tuple(r for r in b.ranks if below <= r < below + row["c"])
            brackets.append(Bracket(b.series, row["lo"], row["hi"], below, row["c"], ranks))


def _selected(picked: DataFrame, names: list[str], probabilities: list[float], by: list[str]) -> DataFrame:
    long = (
        picked.select(
            *by,
            F.explode(
                F.array(*[F.struct(F.lit(i).alias("series"), F.col(f"v{i}").alias("v")) for i in range(len(names))])
            ).alias("s"),
            "w",
        )
        .where(F.col("s.v").isNotNull() & (F.col("w") > 0))
        .select(*by, "s.series", F.greatest(F.least(F.col("s.v"), F.lit(LARGEST)), F.lit(-LARGEST)).alias("v"), F.col("s.v").alias("raw"), "w")
    )
    keys = [*by, "series"]

    ranks = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.array(
                        F.floor(F.lit(float(p)) * (F.col("n") - 1)).cast("long"),
                        F.ceil(F.lit(float(p)) * (F.col("n") - 1)).cast("long"),
                    )
                    for p in probabilities
                ]
            )
        )
    )
    sizes = checkpointed(
        long.groupBy(*keys).agg(
            F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.coalesce(F.sum(F.when(F.col("raw") < -LARGEST, F.col("w"))), F.lit(0)).alias("low"),
            F.coalesce(F.sum(F.when(F.col("raw") > LARGEST, F.col("w"))), F.lit(0)).alias("high"),
        )
    )
    whole = F.col("n").alias("held")
    open_ = sizes.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), whole)
    done: DataFrame | None = None
    while True:
        settled = open_.where(F.col("lo") == F.col("hi")).select(*keys, "rank", F.col("lo").alias("v"))
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.where(F.col("lo") < F.col("hi"))
        left, held = open_.agg(F.count(F.lit(1)), F.sum("held")).first()
        if left == 0:
            break
        open_ = checkpointed(_narrow(long, open_, keys, left, by_value=held <= builtin_limit(picked)))

    filled = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    merged = sizes.join(filled, keys)
    lower = [F.floor(F.lit(float(p)) * (F.col("n") - 1)).cast("long") for p in probabilities]
    upper = [F.ceil(F.lit(float(p)) * (F.col("n") - 1)).cast("long") for p in probabilities]

    def value(rank: Column) -> Column:
        infinite = F.when(rank < F.col("low"), -math.inf).when(rank >= F.col("n") - F.col("high"), math.inf)
        return F.coalesce(infinite, F.col("at")[rank])

    def between(p: float, lo: Column, hi: Column) -> Column:
        a, b = value(lo), value(hi)
        return F.when(a == b, a).otherwise(a + (b - a) * (F.lit(float(p)) * (F.col("n") - 1) - lo))

    interpolated = F.array(*[between(p, lo, hi) for p, lo, hi in zip(probabilities, lower, upper)])
    per_series = merged.select(*keys, interpolated.alias("q"))
    return per_series.groupBy(*by).agg(
        *[F.max(F.when(F.col("series") == i, F.col("q"))).alias(name) for i, name in enumerate(names)]
    )


def _narrow(long: DataFrame, open_: DataFrame, keys: list[str], open_rows: int, by_value: bool) -> DataFrame:
    """Replace every open bracket by the one of its buckets that holds the wanted rank; with
    ``by_value`` every distinct value is a bucket, which settles the bracket."""
    brackets = open_.select(*[F.col(k).alias(f"b_{k}") for k in keys], "rank", "lo", "hi", "below")
    # Brackets grow with the number of groups, so they are broadcast only when counted to be few.
    brackets = F.broadcast(brackets) if open_rows <= BROADCAST_BRACKETS else brackets
    same_group = F.lit(True)
    for k in keys:
        same_group = same_group & long[k].eqNullSafe(F.col(f"b_{k}"))
    inside = long.join(brackets, same_group & F.col("v").between(F.col("lo"), F.col("hi")))
    if by_value:
        bucket = F.col("v")
    else:
        # Only correctly rounded steps, so a larger value never falls into a lower bucket.
        buckets = max(FEWEST_BUCKETS, min(MOST_BUCKETS, COUNTERS // open_rows))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    counted = (
        inside.withColumn("bucket", bucket)
        .groupBy(*keys, "rank", "below", "bucket")
        .agg(F.sum("w").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    running = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("bucket"))
    return (
        counted.withColumn("upto", F.col("below") + running)
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        .select(*keys, "rank", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("held"))
    )


def quantile_row(df: DataFrame, values: dict[str, Column], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of whole columns as plain numbers: one row, as many entries as columns."""
    if not values:
        return {}
    return quantiles(df, values, probabilities).first().asDict()


def bin_ends(df: DataFrame, values: dict[str, Column], bins: int) -> dict[str, list[float]]:
    """Per column that has values the upper ends of all but the last of ``bins`` bins of about equally many values.

    All values are counted. An end is a value of the column; it is off its rank by ``BIN_SLACK`` of a bin at most (columns of up to
    ``bins / BIN_SLACK`` values: not at all) or stands for more equal values than that.
    """
    names = list(values)
    picked = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())], F.lit(1).cast("long").alias("w"))
    ends: dict[str, list[float]] = {}
    for at in range(0, len(names), COLUMNS_PER_PASS):
        long, sizes = _series(picked, range(at, min(at + COLUMNS_PER_PASS, len(names))))
        ranks = {i: [k * (r["n"] - 1) // bins for k in range(1, bins)] for i, r in sizes.items()}
        brackets = [Bracket(i, r["lo"], r["hi"], 0, r["n"], tuple(sorted(set(ranks[i])))) for i, r in sizes.items()]
        found = _narrowed(long, brackets, {i: int(r["n"] / bins * BIN_SLACK) for i, r in sizes.items()})
        ends |= {names[i]: sorted({found[i, r] for r in ranks[i]}) for i in sizes}
    return ends
