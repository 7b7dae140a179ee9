"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtally.session import scratch_path

# A word is a run of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = 2**63 - 1

Batches = Iterator[pa.RecordBatch]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rows_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = fn(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run


def ordered_id(column: str | Column) -> Column:
    """Ids for comparisons: a null id comes after every other."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LAST_ID)).cast("long")


def row_key(*columns: str) -> Column:
    """A 64-bit identity of a row by its content; rows that repeat share it, and every decision made by it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
