"""Sinks: derived datasets, managed versions, CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION_PREFIX = "version="
WHOLE = "whole"  # label of a version that replaces all before it


def csv_options(null_mark: str | None = None) -> dict[str, str]:
    """The one convention of sink and reader: a quote inside a field is doubled, line breaks stay, blanks stay."""
    options = {"quote": '"', "escape": '"', "lineSep": "\n"}
    return {**options, "nullValue": null_mark} if null_mark is not None else options


def write_csv(df: DataFrame, path: str, null_mark: str | None = None, quote_all: bool = True) -> str:
    """A CSV folder with a header line in every part, from which texts come back as they were.

    With ``quote_all=False`` only the fields that need it are quoted; readers that skip blanks after a separator then lose
    those at the start of a text. An empty text and a null are both an empty field, which reads as null; ``null_mark`` keeps
    them apart.
    """
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("errorifexists").options(header="true", quoteAll=str(quote_all).lower(), **blanks, **csv_options(null_mark)).csv(path)
    return path


def next_version_name(spark: SparkSession, base: str, label: str | None = None) -> str:
    """Versions are numbered, so that their names sort in the order they were added."""
    taken = [int(v.rstrip("/").rsplit("=", 1)[1].split("-", 1)[0]) for v in _versions(spark, base)]
    number = max(taken, default=0) + 1
    return f"{VERSION_PREFIX}{number:012d}-{label or uuid.uuid4().hex[:8]}"


def write_version(df: DataFrame, base: str, label: str | None = None, partition_by: list[str] | None = None) -> str:
    """Materialise as Parquet in a folder of its own and return its path.

    A version that is being read is never overwritten; the caller points its record at the new
    path only after the write has committed, which makes the switch atomic.
    """
    path = f"{base.rstrip('/')}/{next_version_name(df.sparkSession, base, label)}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def _versions(spark: SparkSession, base: str, committed: bool = False) -> list[str]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    paths = [status.getPath() for status in fs.listStatus(folder)]
    return sorted(
        p.toString()
        for p in paths
        if p.getName().startswith(VERSION_PREFIX)
        and (not committed or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    )


def committed_versions(spark: SparkSession, base: str) -> list[str]:
    """Finished versions below ``base``, oldest first (any file system Spark can reach), from the last whole one on."""
    versions = _versions(spark, base, committed=True)
    whole = [k for k, v in enumerate(versions) if v.rstrip("/").endswith(f"-{WHOLE}")]
    return versions[whole[-1] :] if whole else versions
