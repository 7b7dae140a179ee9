"""Column roles and typed views of columns; schema inspection only, no jobs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.parsing import parse_datetime, parse_number
from prismtally.functions.rounding import nearest

DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"Column '{name}' was not found.")
    return df.schema[name].dataType


def col(name: str) -> Column:
    """Reference by exact name, also when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers without booleans."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    taken = set(numeric_columns(df)) | set(datetime_columns(df))
    return [c for c in df.columns if c not in taken]


def is_profiled_as_number(dtype: T.DataType) -> bool:
    """Booleans are charted as categories but profiled and typed as numbers."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    return "text"


def role_listing(df: DataFrame) -> DataFrame:
    """P10: one row per column with its chart role."""
    numeric, dates = set(numeric_columns(df)), set(datetime_columns(df))
    rows = [
        (i, c, "numeric" if c in numeric else "datetime" if c in dates else "categorical")
        for i, c in enumerate(df.columns)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, role string")


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a frame with a partition for every ten thousand.

    They go as Arrow data. A plain list would be pickled, dealt over all cores and read back by a Python worker on each, from a second set of
    workers beside those of the Arrow functions; both sets stay and hold their memory.
    """
    struct = T.StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], struct)
    columns = [pa.array(values) for values in zip(*rows, strict=True)]
    return spark.createDataFrame(pa.table(columns, names=struct.names), struct).coalesce(1 + len(rows) // 10_000)


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; unparsable text and NaN become null."""
    dtype = field_type(df, name)
    c = col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        wide = c.cast("double")
        return F.when(~F.isnan(wide), wide)
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.StringType):
        return parse_number(c)
    return F.lit(None).cast("double")


def moment(df: DataFrame, name: str) -> Column:
    """The column as a zone-less timestamp; unparsable text becomes null."""
    dtype = field_type(df, name)
    c = col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, DATETIME_TYPES):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return parse_datetime(c)
    if isinstance(dtype, T.NumericType):
        # Numbers count nanoseconds since the epoch.
        return F.timestamp_micros(F.floor(number(df, name) / 1000)).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


CALENDAR_UNITS = ("week", "month", "quarter", "year")


def period_start(moment_: Column, unit: str) -> Column:
    """Start of the calendar unit of a zone-less timestamp, whatever the session time zone."""
    if unit == "day":
        return F.to_date(moment_).cast("timestamp_ntz")
    if unit in CALENDAR_UNITS:
        return F.trunc(F.to_date(moment_), unit).cast("timestamp_ntz")
    return F.date_trunc(unit, moment_).cast("timestamp_ntz")


def epoch_micros(moment_: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    of_day = (
        F.hour(moment_).cast("long") * 3_600_000_000
        + F.minute(moment_).cast("long") * 60_000_000
        + (F.date_part(F.lit("SECOND"), moment_) * 1_000_000).cast("long")
    )
    return F.unix_date(F.to_date(moment_)).cast("long") * 86_400_000_000 + of_day


def as_text(df: DataFrame, name: str) -> Column:
    """The column as comparable text; nested values as JSON, NaN as null."""
    dtype = field_type(df, name)
    c = col(name)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = col(name)
    if isinstance(field_type(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def ratio_pct(numerator: Column, denominator: Column) -> Column:
    """Percentage with two decimals, 0 when the denominator is 0."""
    share = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return nearest(F.coalesce(share * 100, F.lit(0.0)), 2)
