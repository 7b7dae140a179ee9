"""SQLite tables as a partitioned Spark source.

The path is one database file or a folder of them, on storage mounted on every executor. Each
file is split into row-id ranges; a task reads one range and hands Arrow batches to Spark.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismtally.session import local_path

EXTENSIONS = (".db", ".sqlite", ".sqlite3")
BATCH_ROWS = 8192
ROWS_PER_PARTITION = 1_000_000


def _open(path: str) -> sqlite3.Connection:
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    connection.text_factory = lambda b: b.decode("utf-8", "replace")
    return connection


def _quoted(name: str) -> str:
    return '"' + str(name).replace('"', '""') + '"'


def database_files(path: str) -> list[str]:
    root = Path(local_path(path))
    if root.is_dir():
        return sorted(str(p) for p in root.iterdir() if p.suffix.lower() in EXTENSIONS)
    return [str(root)]


def list_tables(path: str) -> list[str]:
    """User tables by name, over all files of the path."""
    names: set[str] = set()
    for file in database_files(path):
        with _open(file) as db:
            found = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'")
            names.update(r[0] for r in found)
    return sorted(names)


def choose_table(path: str, table: str | None = None) -> str:
    """The wanted table, else the first one (by name) that holds rows."""
    names = list_tables(path)
    if not names:
        raise ValueError(f"No table in {path!r}.")
    for name in [table] if table else names:
        for file in database_files(path):
            with _open(file) as db:
                try:
                    if db.execute(f"SELECT 1 FROM {_quoted(name)} LIMIT 1").fetchone():
                        return name
                except sqlite3.OperationalError:
                    continue
    raise ValueError(f"No rows could be read from {table or 'any table'} of {path!r}.")


def _spark_type(declared: str) -> T.DataType:
    """Column affinity by the declared type, as SQLite derives it."""
    text = (declared or "").upper()
    if "INT" in text:
        return T.LongType()
    if any(w in text for w in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if any(w in text for w in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if text == "BLOB" else T.StringType()


class RowRange(InputPartition):
    def __init__(self, file: str, first: int | None, last: int | None):
        self.file, self.first, self.last = file, first, last


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.path, self.table = options["path"], options["table"]
        self.rows_per_partition = int(options.get("rowsperpartition", ROWS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        ranges: list[InputPartition] = []
        for file in database_files(self.path):
            with _open(file) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # no row ids (or no such table in this file)
                    if self.table in list_tables(file):
                        ranges.append(RowRange(file, None, None))
                    continue
            if low is not None:
                ranges += [
                    RowRange(file, at, min(at + self.rows_per_partition - 1, high))
                    for at in range(low, high + 1, self.rows_per_partition)
                ]
        return ranges

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        columns = ", ".join(_quoted(n) for n, _ in self.fields)
        sql = f"SELECT {columns} FROM {_quoted(self.table)}"
        bounds: tuple = ()
        if partition.first is not None:
            sql, bounds = sql + " WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)
        with _open(partition.file) as db:
            cursor = db.execute(sql, bounds)
            while rows := cursor.fetchmany(BATCH_ROWS):
                arrays = [
                    pa.array([_fitted(v, dtype) for v in values], _ARROW[type(dtype)])
                    for values, (_, dtype) in zip(zip(*rows), self.fields)
                ]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in self.fields])


_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def _fitted(value, dtype: T.DataType):
    """SQLite types values, not columns: what does not fit the declared type becomes null."""
    if value is None:
        return None
    if isinstance(dtype, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(dtype, T.BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(dtype, T.DoubleType):
        return number
    return value if isinstance(value, int) else int(number) if number.is_integer() else None


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").option("table", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        table = self.options["table"]
        for file in database_files(self.options["path"]):
            with _open(file) as db:
                info = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
            if info:
                return T.StructType([T.StructField(r[1], _spark_type(r[2])) for r in info])
        raise ValueError(f"Table '{table}' was not found.")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, rows_per_partition: int | None = None) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format(SqliteSource.name()).option("table", choose_table(path, table))
    if rows_per_partition:
        reader = reader.option("rowsPerPartition", rows_per_partition)
    return reader.load(path)
