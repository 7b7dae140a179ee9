"""Value counts of many columns with one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import as_text, col
from prismtally.functions.parsing import strip

DIGEST_OVER = 64  # characters; a digest has 64


def long_form(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, value) rows of the non-null values; narrow, no shuffle."""
    if not values:
        return df.sparkSession.createDataFrame([], "column string, value string")
    entries = [F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in values.items()]
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.column", "e.value").where(
        F.col("value").isNotNull()
    )


def digest(text: Column) -> Column:
    """A stand-in for equality only: long texts become their SHA-256 digest, so that whole
    documents are never shuffled."""
    return F.when(F.length(text) > DIGEST_OVER, F.sha2(text, 256)).otherwise(text)


def may_be_long(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType))


def key_text(df: DataFrame, column: str) -> Column:
    """A column as a key to compare across tables: stripped text, long ones as digests."""
    if may_be_long(df.schema[column].dataType):
        return digest(strip(as_text(df, column)))
    return as_text(df, column)


def digests(df: DataFrame, columns: list[str] | None = None) -> dict[str, Column]:
    """Texts for counting distinct values."""
    return {
        c: digest(as_text(df, c)) if may_be_long(df.schema[c].dataType) else as_text(df, c)
        for c in (columns if columns is not None else df.columns)
    }


STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a whole row (32 bytes): equal for equal rows only; missing values differ from empty ones."""
    parts = []
    for f in df.schema.fields:
        c = col(f.name)
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        text = F.to_json(c, {**STAMPS, "ignoreNullFields": "false"}) if nested else F.base64(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
        # The length in front keeps neighbouring texts apart.
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def value_counts(df: DataFrame, columns: list[str] | None = None, texts: dict[str, Column] | None = None) -> DataFrame:
    """(column, value, n). The shuffle key is (column, value), so neither a wide table nor a
    column dominated by one value lands in one task: equal values collapse before the shuffle."""
    if texts is None:
        texts = {c: as_text(df, c) for c in (columns if columns is not None else df.columns)}
    return long_form(df, texts).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int, by_value: bool = False) -> DataFrame:
    """The ``k`` most frequent values per column (or the k smallest with ``by_value``), ties by value.

    The rank filter is cut per task before the shuffle (window group limit), so a column with
    very many distinct values still sends only ``k`` rows per task.
    """
    order = [F.col("value")] if by_value else [F.desc("n"), F.col("value")]
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
