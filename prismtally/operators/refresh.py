"""Full and incremental refresh, schema drift and freshness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import as_text, col, field_type, moment, number


@dataclass(frozen=True)
class AppendResult:
    """The refreshed rows (lazy), how they came about, and why; the cursor column where one was used."""

    frame: DataFrame
    mode: str
    reason: str
    added: DataFrame | None = None
    cursor: str | None = None


APPENDED = "Rows beyond the cursor were added to the rows held."


def append_obstacle(current: DataFrame, source: DataFrame, cursor: str | None) -> str:
    """Why rows cannot be appended, or an empty text."""
    if current.columns != source.columns:
        gone, new = (sorted(set(a.columns) - set(b.columns)) for a, b in ((current, source), (source, current)))
        changed = "; ".join(f"{what}: {', '.join(names)}" for what, names in (("missing now", gone), ("new", new)) if names)
        return f"The columns changed ({changed or 'order'})."
    return "" if cursor in current.columns else f"There is no cursor column {cursor!r}."


def incremental_append(
    current: DataFrame,
    source: DataFrame,
    cursor: str | None,
    current_distinct: bool = False,
    newest: DataFrame | None = None,
) -> AppendResult:
    """Append the source rows beyond the cursor, then drop duplicates over everything.

    Number and date cursors compare with the largest value already held (one value, read ahead, so
    that the bound reaches the file scan of the source as a literal). A late row at or below it is skipped. Any other
    text cursor takes the rows whose value is not held yet. Where that cannot be done the
    source replaces the data and the reason says so.

    ``added`` are the new rows alone. They never repeat a held row, so data already known to be
    free of duplicates (``current_distinct``) needs no second look: only ``added`` is shuffled.
    ``newest`` is the part of ``current`` known to hold its largest cursor, if there is one; the
    cursor is then read from that part alone.
    """
    obstacle = append_obstacle(current, source, cursor)
    if obstacle:
        return AppendResult(source, "full_fallback", obstacle)
    added = new_rows(current, source, cursor, newest)
    held = current if current_distinct else current.dropDuplicates()
    return AppendResult(held.unionByName(added), "incremental", APPENDED, added, cursor)


def new_rows(current: DataFrame, source: DataFrame, cursor: str, newest: DataFrame | None = None) -> DataFrame:
    """The distinct source rows beyond the cursor that ``current`` does not hold."""
    textual = isinstance(field_type(source, cursor), T.StringType)
    new = delta_rows(current if textual or newest is None else newest, source, cursor)
    if textual:
        # A missing text is never among the held ones, so such rows are compared whole.
        missing = col(cursor).isNull()
        new = new.where(~missing).dropDuplicates().unionByName(new.where(missing).subtract(current.where(missing)))
        return new
    return new.dropDuplicates()


def delta_rows(current: DataFrame, source: DataFrame, cursor: str) -> DataFrame:
    dtype = field_type(source, cursor)
    plain = not isinstance(dtype, (T.StringType, T.DoubleType, T.FloatType))
    if plain and field_type(current, cursor) == dtype:
        # The bare column, so that the bound is pushed down to the scan.
        return _beyond(current, source, col(cursor), col(cursor))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return _beyond(current, source, number(current, cursor), number(source, cursor))
    if not isinstance(dtype, T.StringType):
        return _beyond(current, source, moment(current, cursor), moment(source, cursor))
    dated = not source.select(moment(source, cursor).alias("t")).where("t IS NOT NULL").isEmpty()
    if dated and not current.select(moment(current, cursor).alias("t")).where("t IS NOT NULL").isEmpty():
        return _beyond(current, source, moment(current, cursor), moment(source, cursor))
    # Distinct held values only, so a hot value is a single row on the lookup side; the anti
    # join never multiplies rows and its skewed partitions are split by AQE.
    held = current.select(as_text(current, cursor).alias("_held")).where("_held IS NOT NULL").distinct()
    return source.join(held, as_text(source, cursor) == F.col("_held"), "left_anti")


def _beyond(current: DataFrame, source: DataFrame, held, incoming) -> DataFrame:
    latest = current.agg(F.max(held).alias("latest")).first()["latest"]
    return source if latest is None else source.where(incoming > F.lit(latest))


def append_details(result: AppendResult, current: DataFrame) -> DataFrame:
    """Mode, reason, rows added (negative when the old data held duplicates), cursor column and its largest value; one row."""
    before = F.lit(0).cast("long") if result.mode != "incremental" else current.agg(F.count(F.lit(1))).scalar()
    latest = F.max(col(result.cursor)).cast("string") if result.cursor else F.lit(None).cast("string")
    return result.frame.agg(F.count(F.lit(1)).alias("rows"), latest.alias("cursor_value")).select(
        F.lit(result.mode).alias("mode"),
        F.lit(result.reason).alias("reason"),
        (F.col("rows") - before).alias("rows_added"),
        F.lit(result.cursor).cast("string").alias("cursor_column"),
        "cursor_value",
    )


def schema_snapshot(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def snapshot_frame(spark, snapshots: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(dataset, column, dtype) rows of many schemas, the form drift and sensitivity work on."""
    rows = [(d, i, c, t) for d, fields in snapshots.items() for i, (c, t) in enumerate(fields)]
    return spark.createDataFrame(rows, "dataset string, position int, column string, dtype string")


def schema_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(dataset, column, change, previous, current) for all datasets of a catalog at once."""
    before = previous.select("dataset", "column", F.col("dtype").alias("previous"))
    after = current.select("dataset", "column", F.col("dtype").alias("current"))
    change = (
        F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").otherwise("type_changed")
    )
    return (
        before.join(after, ["dataset", "column"], "full")
        .where(~F.col("previous").eqNullSafe(F.col("current")))
        .select("dataset", "column", change.alias("change"), "previous", "current")
    )


def freshness(catalog: DataFrame, source_times: DataFrame | None = None) -> DataFrame:
    """(id, status) for every record of a catalog.

    ``catalog``: id, source_type, parent_dataset_id, updated_at, last_refreshed_at.
    ``source_times``: id, modified_at of the source files (see ``source_modified``).
    """
    parent = catalog.select(F.col("id").alias("parent_dataset_id"), F.col("updated_at").alias("parent_updated_at"))
    joined = catalog.join(parent, "parent_dataset_id", "left")
    if source_times is None:
        joined = joined.withColumn("modified_at", F.lit(None).cast("timestamp"))
    else:
        joined = joined.join(source_times, "id", "left")
    compared = F.coalesce("last_refreshed_at", "updated_at")
    stale = F.col("source_type").isin("upload", "sample") & (F.col("modified_at") > compared)
    upstream = F.col("source_type").isin("derived", "joined", "rebuilt") & (
        F.col("parent_updated_at") > F.col("updated_at")
    )
    return joined.select(
        "id", F.when(stale, "stale_source").when(upstream, "upstream_changed").otherwise("current").alias("status")
    )


def source_modified(spark, paths: dict[str, str], file_format: str = "parquet") -> DataFrame:
    """(id, modified_at): the newest file time behind each record, from file metadata only."""
    parts = [
        spark.read.format(file_format)
        .load(path)
        .agg(F.max("_metadata.file_modification_time").alias("modified_at"))
        .select(F.lit(i).alias("id"), "modified_at")
        for i, path in paths.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
