"""Incremental refresh of a managed dataset from new files (the micro-batch form of R2).

The managed dataset is a folder of committed versions whose union is the snapshot. What counts as new is settled once per
run, by the versions held when it began: their largest cursor (or their cursor texts) is read once and every batch is filtered by it. Rows that
repeat, in a batch, across batches or across runs, are dropped by the state of the stream, which keeps a digest of 32 bytes per row it has
seen. So a batch costs its own rows, whatever the run has added before, and neither the order of the files nor their number per batch
changes the answer. A run that did not end goes on with the versions it began with.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import DATETIME_TYPES, col, field_type, moment, number
from prismtally.functions.frequencies import row_digest
from prismtally.operators.refresh import new_rows
from prismtally.sources.writers import WHOLE, committed_versions, write_version

PARTITIONS = "spark.sql.shuffle.partitions"
RUN_LOG = "run long, held array<string>, state string"


def snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    """The union of the committed versions, or None before the first one."""
    versions = committed_versions(spark, base)
    return spark.read.parquet(*versions) if versions else None


def compact(spark: SparkSession, base: str) -> str | None:
    """Write the snapshot as one version that replaces all earlier ones; those stay on disk but are no longer listed."""
    held = snapshot(spark, base)
    return None if held is None else write_version(held, base, WHOLE)


def append_batch(batch: DataFrame, base: str, cursor: str, label: str | None = None) -> str | None:
    """Add the new distinct rows of ``batch`` as a version; returns its path, None if nothing is new.

    The batch is computed once: it is written, and an empty version adds nothing.
    """
    spark = batch.sparkSession
    held = committed_versions(spark, base)
    new = new_rows(spark.read.parquet(*held), batch, cursor) if held else batch.dropDuplicates()
    path = write_version(new, base, label)
    return None if spark.read.parquet(path).isEmpty() else path


def beyond(spark: SparkSession, held: list[str], sample: DataFrame, cursor: str, scratch: str) -> Callable[[DataFrame], DataFrame]:
    """The filter of one run: rows of a batch beyond the cursor of the ``held`` versions. They are read here, once.

    A number or instant is compared with one literal. The different texts of a text cursor are written to ``scratch``, and rows
    without a cursor text to another table there; both are narrow and batches are joined with them.
    """
    if not held:
        return lambda batch: batch
    current = spark.read.parquet(*held)
    if not isinstance(field_type(sample, cursor), T.StringType):
        typed = moment if isinstance(field_type(sample, cursor), DATETIME_TYPES) else number
        exact = field_type(current, cursor) == field_type(sample, cursor) and not isinstance(field_type(sample, cursor), (T.DoubleType, T.FloatType))
        value = (lambda df: col(cursor)) if exact else (lambda df: typed(df, cursor))
        latest = current.agg(F.max(value(current))).first()[0]
        return lambda batch: batch if latest is None else batch.where(value(batch) > F.lit(latest))
    dated = current.agg(F.max(moment(current, cursor))).first()[0]
    current.select(col(cursor).alias("_held")).where("_held IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{scratch}/texts")
    current.where(col(cursor).isNull()).select(row_digest(current).alias("_digest")).distinct().write.mode("overwrite").parquet(f"{scratch}/without")
    texts, without = spark.read.parquet(f"{scratch}/texts"), spark.read.parquet(f"{scratch}/without")

    def new(batch: DataFrame) -> DataFrame:
        missing = col(cursor).isNull()
        bare = batch.where(missing).withColumn("_digest", row_digest(batch)).join(without, "_digest", "left_anti").drop("_digest")
        filled = batch.where(~missing)
        if dated is not None and not filled.where(moment(filled, cursor).isNotNull()).isEmpty():
            return filled.where(moment(filled, cursor) > F.lit(dated)).unionByName(bare)
        return filled.join(texts, col(cursor) == F.col("_held"), "left_anti").unionByName(bare)

    return new


def _run_start(spark: SparkSession, base: str, log: str) -> tuple[int, list[str]]:
    """Number of the run and the versions it compares with: those of an unfinished run, else the ones there are now."""
    try:
        last = spark.read.schema(RUN_LOG).parquet(log).orderBy(F.desc("run"), F.col("state") == "begun").first()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = None
    if last is not None and last["state"] == "begun":
        return last["run"], list(last["held"])
    run, held = (last["run"] + 1 if last else 0), committed_versions(spark, base)
    _note(spark, log, run, held, "begun")
    return run, held


def _note(spark: SparkSession, log: str, run: int, held: list[str], state: str) -> None:
    spark.createDataFrame([(run, held, state)], RUN_LOG).coalesce(1).write.mode("append").parquet(log)


def refresh_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    base: str,
    cursor: str,
    checkpoint: str,
    file_format: str = "parquet",
    max_files_per_batch: int | None = None,
    options: dict | None = None,
    state_partitions: int | None = None,
):
    """Process all files that have arrived and return the ended query; run again whenever more may have come.

    Each batch writes one version labelled with the stream and its id, so a batch that is retried after a failure
    is recognised and not applied twice. One writer at a time may work on a managed folder.

    A batch has a task for each of ``state_partitions``, however few rows it brings, and nothing joins them later. Unless given they are
    three per core of the cluster, or the shuffle partitions of the session if those are fewer; the first run settles them for its checkpoint.
    """
    reader = spark.readStream.format(file_format).schema(schema).options(**(options or {}))
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    stream = f"{zlib.crc32(checkpoint.encode()):08x}"
    log = f"{checkpoint.rstrip('/')}-runs"
    run, held = _run_start(spark, base, log)
    arriving = reader.load(source)
    new = beyond(spark, held, arriving, cursor, f"{checkpoint.rstrip('/')}-held/{run}")
    if not isinstance(field_type(arriving, cursor), T.StringType):
        # One literal decides, so rows that are not new are dropped where they are read: they are not shuffled and leave no state. A later
        # run begins no lower, so it drops them again.
        arriving, new = new(arriving), lambda batch: batch

    def apply(batch: DataFrame, batch_id: int) -> None:
        label = f"batch-{stream}-{batch_id:012d}"
        done = committed_versions(batch.sparkSession, base)
        if not any(path.rstrip("/").endswith(label) for path in done):
            write_version(new(batch.drop("_digest")), base, label)

    writer = (
        arriving.withColumn("_digest", row_digest(arriving))
        .dropDuplicates(["_digest"])
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    partitions = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, state_partitions or min(int(partitions), 3 * spark.sparkContext.defaultParallelism))
    try:
        query = writer.start()  # has a copy of the settings from here on
    finally:
        spark.conf.set(PARTITIONS, partitions)
    query.awaitTermination()
    _note(spark, log, run, held, "ended")
    return query
