"""Dataset records, lineage replay and dataset joins.

With a store a rebuilt record is written once and found again by the fingerprint of everything it depends on: its step, the records it is
built from, and the files at the roots (names, sizes, times of change). A changed file or step gives another fingerprint, so what was
stored before is not found any more; nothing is ever overwritten.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtally.operators.joins import join_on_keys
from prismtally.operators.transforms import apply_transform
from prismtally.sources.readers import read_dataset

SOURCE_TYPES = ("upload", "sample")


@dataclass(frozen=True)
class JoinSpec:
    left_dataset_id: str
    right_dataset_id: str
    left_column: str
    right_column: str
    join_type: str = "left"


@dataclass(frozen=True)
class DatasetRecord:
    """How a dataset came about: read from a path, or built from other records."""

    id: str
    source_type: str
    stored_path: str | None = None
    parent_dataset_id: str | None = None
    steps: tuple[dict, ...] = ()
    join: JoinSpec | None = None
    source_table: str | None = None
    owner: str | None = None
    row_policies: tuple[dict, ...] = field(default=())


def source_version(spark: SparkSession, path: str) -> str:
    """A digest of the files at a path from their listing alone; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    seen = files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("string"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()
    return "/".join(map(str, seen))


class Lineage:
    """Builds records of a catalog, each once, so shared parents are one plan and Catalyst can reuse its exchanges.

    ``store`` is a folder in which results that were asked for before are found again.
    """

    def __init__(self, spark: SparkSession, catalog: Mapping[str, DatasetRecord], store: str | None = None) -> None:
        self.spark, self.catalog, self.store = spark, catalog, store
        self.built: dict[str, DataFrame] = {}
        self.prints: dict[str, str] = {}

    def _record(self, record_id: str | None, wanted_by: str) -> DatasetRecord:
        if record_id not in self.catalog:
            raise ValueError(f"No record {record_id!r} in the catalog, which {wanted_by} needs.")
        record = self.catalog[record_id]
        builder = BUILDERS.get(record.source_type)
        if builder is None or not builder.needs(record):
            raise ValueError(f"Record {record.id!r} of type {record.source_type!r} does not say how to build it.")
        return record

    def frame(self, record_id: str | None, wanted_by: str = "the caller") -> DataFrame:
        if record_id not in self.built:
            record = self._record(record_id, wanted_by)
            found = self._found(record_id) if self.store and record.source_type not in SOURCE_TYPES else None
            self.built[record_id] = found if found is not None else BUILDERS[record.source_type].build(self, record)
        return self.built[record_id]

    def fingerprint(self, record_id: str | None, wanted_by: str = "the caller") -> str:
        """Of what a record is built from and how, down to the files; the name of the record does not count."""
        if record_id not in self.prints:
            record = self._record(record_id, wanted_by)
            parents = [record.join.left_dataset_id, record.join.right_dataset_id] if record.source_type == "joined" else [record.parent_dataset_id]
            about: list = [record.source_type]
            if record.source_type in SOURCE_TYPES:
                about += [source_version(self.spark, record.stored_path), record.stored_path, record.source_table]
            else:
                about += [self.fingerprint(p, record.id) for p in parents]
                about += [asdict(record.join) if record.source_type == "joined" else record.steps[-1] if record.source_type == "derived" else None]
            self.prints[record_id] = hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()
        return self.prints[record_id]

    def _place(self, record_id: str) -> str:
        return f"{self.store.rstrip('/')}/{self.fingerprint(record_id)}"

    def _found(self, record_id: str) -> DataFrame | None:
        place = self._place(record_id)
        try:
            self.spark.read.parquet(f"{place}/done")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None
        return self.spark.read.parquet(f"{place}/rows")

    def stored(self, record_id: str) -> DataFrame:
        """The rows of a record from the store, written first if they are not there."""
        self.frame(record_id)
        found = self._found(record_id)
        if found is None:
            place = self._place(record_id)
            # Rows without a mark are left over from a writer that did not end.
            self.built[record_id].write.mode("overwrite").parquet(f"{place}/rows")
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{place}/done")
            found = self._found(record_id)
        self.built[record_id] = found
        return found


@dataclass(frozen=True)
class Builder:
    """What a record of one source type must have, and how its frame is made."""

    needs: Callable[[DatasetRecord], bool]
    build: Callable[[Lineage, DatasetRecord], DataFrame]


def _stored(lineage: Lineage, record: DatasetRecord) -> DataFrame:
    return read_dataset(lineage.spark, record.stored_path, table=record.source_table)


def _derived(lineage: Lineage, record: DatasetRecord) -> DataFrame:
    """The last step on the parent; earlier steps are the parents' own."""
    step = record.steps[-1]
    if step.get("kind") != "transform":
        raise ValueError(f"The last step of record {record.id!r} is no transform.")
    return apply_transform(lineage.frame(record.parent_dataset_id, record.id), step.get("operation"), step.get("options"))


def _joined(lineage: Lineage, record: DatasetRecord) -> DataFrame:
    spec = record.join
    sides = [lineage.frame(i, record.id) for i in (spec.left_dataset_id, spec.right_dataset_id)]
    return join_on_keys(*sides, spec.left_column, spec.right_column, spec.join_type)


BUILDERS: dict[str, Builder] = {
    **dict.fromkeys(SOURCE_TYPES, Builder(lambda r: r.stored_path is not None, _stored)),
    "derived": Builder(lambda r: bool(r.steps and r.parent_dataset_id), _derived),
    "joined": Builder(lambda r: bool(r.join and r.join.left_dataset_id and r.join.right_dataset_id), _joined),
    "rebuilt": Builder(lambda r: bool(r.parent_dataset_id), lambda lineage, r: lineage.frame(r.parent_dataset_id, r.id)),
}


def can_rebuild(record: DatasetRecord | None) -> bool:
    """Whether a record says all that its builder needs; uploads and samples are always read anew."""
    if record is None or record.source_type not in BUILDERS:
        return False
    return record.source_type in SOURCE_TYPES or BUILDERS[record.source_type].needs(record)


def rebuild(spark: SparkSession, catalog: Mapping[str, DatasetRecord], record_id: str, store: str | None = None) -> DataFrame:
    """The lazy DataFrame of a record, composed over its lineage; with a ``store`` (a folder) its rows, written there once."""
    lineage = Lineage(spark, catalog, store)
    return lineage.stored(record_id) if store else lineage.frame(record_id)


def join_datasets(
    spark: SparkSession, left: DatasetRecord, right: DatasetRecord, left_key: str, right_key: str, how: str = "left"
) -> DataFrame:
    """Read both records and join them."""
    return join_on_keys(
        read_dataset(spark, left.stored_path, table=left.source_table),
        read_dataset(spark, right.stored_path, table=right.source_table),
        left_key,
        right_key,
        how,
    )
