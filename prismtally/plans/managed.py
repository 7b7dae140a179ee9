"""Managed snapshots: materialise, refresh fully, incrementally or by replay."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from prismtally.operators.refresh import incremental_append, schema_changes, schema_snapshot, snapshot_frame
from prismtally.plans.replay import SOURCE_TYPES, DatasetRecord, can_rebuild, rebuild
from prismtally.sources.readers import read_dataset
from prismtally.sources.writers import write_version


@dataclass(frozen=True)
class ManagedDataset:
    """A record, the committed folders whose union is its data, and its schema.

    ``distinct`` says that the data is known to hold no duplicate rows; an incremental refresh
    then only adds a folder with the new rows and leaves the others as they are.
    """

    record: DatasetRecord
    base: str
    versions: tuple[str, ...] = ()
    schema: tuple[tuple[str, str], ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class RefreshOutcome:
    dataset: ManagedDataset
    mode: str
    reason: str
    drift: DataFrame


def current(spark: SparkSession, dataset: ManagedDataset) -> DataFrame:
    return spark.read.parquet(*dataset.versions)


def materialise(spark: SparkSession, dataset: ManagedDataset) -> ManagedDataset:
    """Write the first version unless there is one."""
    if dataset.versions:
        return dataset
    source = read_dataset(spark, dataset.record.stored_path, table=dataset.record.source_table)
    return replace(dataset, versions=(write_version(source, dataset.base),), schema=tuple(schema_snapshot(source)))


@dataclass(frozen=True)
class Refreshed:
    """Rows of a refresh and where they go: as a new snapshot, or (``added``) beside the held versions."""

    frame: DataFrame
    mode: str
    reason: str
    added: DataFrame | None = None


def _read(spark: SparkSession, record: DatasetRecord) -> DataFrame:
    return read_dataset(spark, record.stored_path, table=record.source_table)


def _appended(spark: SparkSession, dataset: ManagedDataset, cursor: str | None) -> Refreshed:
    # Added versions only hold rows beyond all earlier ones, so the last one holds the cursor.
    newest = spark.read.parquet(dataset.versions[-1]) if dataset.distinct else None
    result = incremental_append(current(spark, dataset), _read(spark, dataset.record), cursor, dataset.distinct, newest)
    return Refreshed(result.frame, result.mode, result.reason, result.added if dataset.distinct else None)


def _replaced(spark: SparkSession, record: DatasetRecord, catalog: Mapping[str, DatasetRecord], store: str | None) -> Refreshed:
    """The whole source again: by lineage where the record has one and a catalog is given, else from its path."""
    if record.source_type not in SOURCE_TYPES and catalog and can_rebuild(record):
        return Refreshed(rebuild(spark, catalog, record.id, store), "pipeline_rebuild", "Built again from its lineage.")
    if not record.stored_path:
        raise ValueError(f"Record {record.id!r} has neither a lineage nor a path to refresh from.")
    return Refreshed(_read(spark, record), "full", "Read again from its path.")


def refresh(
    spark: SparkSession,
    dataset: ManagedDataset,
    mode: str = "full",
    cursor: str | None = None,
    catalog: Mapping[str, DatasetRecord] | None = None,
    store: str | None = None,
) -> RefreshOutcome:
    """Write the refreshed data and return the dataset pointing at it; an empty result cancels.

    ``store`` is where results of a lineage are kept, so that a rebuild without a change reads them.
    """
    if mode == "incremental":
        dataset = materialise(spark, dataset)
        new = _appended(spark, dataset, cursor)
    else:
        new = _replaced(spark, dataset.record, catalog or {}, store)
    if new.added is not None:
        added = () if new.added.isEmpty() else (write_version(new.added, dataset.base),)
        grown = replace(dataset, versions=dataset.versions + added)
        return RefreshOutcome(grown, new.mode, new.reason, _drift(spark, dataset, list(dataset.schema)))
    if new.frame.isEmpty():
        raise ValueError(f"Nothing to write: the refresh of {dataset.record.id!r} has no rows.")
    fields = schema_snapshot(new.frame)
    path = write_version(new.frame, dataset.base)
    written = replace(dataset, versions=(path,), schema=tuple(fields), distinct=new.mode == "incremental")
    return RefreshOutcome(written, new.mode, new.reason, _drift(spark, dataset, fields))


def _drift(spark: SparkSession, dataset: ManagedDataset, fields: list[tuple[str, str]]) -> DataFrame:
    name = dataset.record.id
    before = snapshot_frame(spark, {name: list(dataset.schema)})
    return schema_changes(before, snapshot_frame(spark, {name: fields}))
