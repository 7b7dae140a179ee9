"""How many different values columns hold: exactly, by type, and by sketch.

Values are counted as what they are, never as texts made of them. Whole numbers (and dates, flags and instants, which are whole numbers too) become
bits of 64-bit words: a word is one row before the shuffle however many of its values occur, so dense ids shrink by up to 64
and scattered ones cost what they would anyway. Floating-point numbers and zone-less timestamps are grouped as they are. Only texts and nested values
travel as texts, long ones as digests.

Theta sketches (the smallest hashes of a column) tell in one scan which columns are far from a gate, so that the exact count is taken of the
others only, and which pairs of columns have certainly too little in common to compare their values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import as_text, col, field_type, present
from prismtally.functions.frequencies import digest, key_text, may_be_long

LOG_ENTRIES = 14
# Five standard errors of a count from so many hashes.
SKETCH_ERROR = 5 / 2 ** (LOG_ENTRIES / 2)
SCHEMA = "column string, unique long"


def whole_number(df: DataFrame, column: str) -> Column | None:
    """The column as whole numbers, one for each of its values; ``None`` if its type has no such form."""
    dtype, c = field_type(df, column), col(column)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return None


def _counted_bits(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    entries = [
        F.struct(F.lit(i).alias("id"), F.shiftright(v, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int")).alias("bits"))
        for i, v in values.items()
    ]
    cells = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("word").isNotNull())
    words = cells.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("unique"))


def _counted_values(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    entries = [F.struct(F.lit(i).alias("id"), v.alias("value")) for i, v in values.items()]
    cells = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("value").isNotNull())
    return cells.groupBy("id", "value").agg(F.lit(1)).groupBy("id").agg(F.count(F.lit(1)).alias("unique"))


def distinct_values(df: DataFrame, columns: list[str], stripped: bool = False) -> DataFrame:
    """``column, unique``: exact numbers of different values that are not missing; ``stripped`` texts differ in more than blanks at their ends.

    A column without values is left out.
    """
    whole, real, moments, texts = {}, {}, {}, {}
    for i, c in enumerate(columns):
        dtype, as_whole = field_type(df, c), whole_number(df, c)
        if as_whole is not None:
            whole[i] = as_whole
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            real[i] = present(df, c).cast("double")
        elif isinstance(dtype, T.TimestampNTZType):
            moments[i] = col(c)
        elif stripped:
            texts[i] = key_text(df, c)
        else:
            texts[i] = digest(as_text(df, c)) if may_be_long(dtype) else as_text(df, c)
    parts = [_counted_bits(df, whole)] if whole else []
    parts += [_counted_values(df, group) for group in (real, moments, texts) if group]
    if not parts:
        return df.sparkSession.createDataFrame([], SCHEMA)
    names = F.array(*[F.lit(c) for c in columns])
    return reduce(DataFrame.unionByName, parts).select(F.element_at(names, F.col("id") + 1).alias("column"), F.col("unique").cast("long").alias("unique"))


def column_sketches(df: DataFrame) -> DataFrame:
    """``column, rows, non_null, estimate, sketch`` from one scan; ``estimate`` is within ``SKETCH_ERROR`` of the number of different values."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        # Columns of any two types meet as texts when they are compared, so all are hashed as that.
        value = key_text(df, c)
        aggs += [F.count(value).alias(f"n{i}"), F.theta_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), LOG_ENTRIES).alias(f"s{i}")]
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("non_null"),
            F.theta_sketch_estimate(f"s{i}").cast("long").alias("estimate"), F.col(f"s{i}").alias("sketch"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def most_shared(intersection: Column, left: Column, right: Column) -> Column:
    """An upper bound (five standard errors) on how many values two columns share, from the estimates of their intersection and of both.

    The intersection is known from a sample that holds at least ``2 ** LOG_ENTRIES`` of the larger column's values.
    """
    share = F.least(F.lit(1.0), F.lit(float(2**LOG_ENTRIES)) / F.greatest(left, right, F.lit(1)))
    seen = intersection * F.least(F.lit(1.0), 2 * share)  # the sample is at most twice as large
    return F.when(share >= 1, intersection).otherwise(intersection + (5 * F.sqrt(seen + 1) + 12) / share)
