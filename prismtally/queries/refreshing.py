"""Refresh, drift, freshness and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.operators import governance, profile, refresh
from prismtally.plans.managed import ManagedDataset, current
from prismtally.plans.managed import refresh as refresh_managed
from prismtally.plans.replay import DatasetRecord
from prismtally.queries.registry import query, table
from prismtally.session import scratch_path
from prismtally.streaming.incremental import append_batch, refresh_available, snapshot

CUT = "1999-01-01"


@query("R1_full_refresh", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def r1(spark, sf):
    dataset = ManagedDataset(DatasetRecord("supplier", "upload", f"{sf}/supplier.parquet"), scratch_path(spark, "managed"))
    return current(spark, refresh_managed(spark, dataset).dataset)


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _held(spark, sf):
    """What an earlier refresh kept: the orders before a date, some of them twice."""
    early = _orders(spark, sf).where(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit(f"{CUT} 00:00:00")))
    return early.unionByName(early.where(F.col("o_orderkey") % 7 == 0))


@query("R2_incremental_dates", "SELECT DISTINCT * FROM orders")
def r2(spark, sf):
    return refresh.incremental_append(_held(spark, sf), _orders(spark, sf), "o_orderdate").frame


@query(
    "R2_append_details",
    f"""WITH held AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'),
             twice AS (SELECT * FROM held UNION ALL SELECT * FROM held WHERE o_orderkey % 7 = 0)
        SELECT 'incremental' AS mode, 'Rows beyond the cursor were added to the rows held.' AS reason,
               CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM twice) AS BIGINT) AS rows_added,
               'o_orderdate' AS cursor_column, (SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders) AS cursor_value""",
)
def r2_details(spark, sf):
    held = _held(spark, sf)
    return refresh.append_details(refresh.incremental_append(held, _orders(spark, sf), "o_orderdate"), held)


@query(
    "R2_incremental_numbers",
    """SELECT * FROM (SELECT event_id, event_type, value FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) AND event_id % 3 = 0)
       UNION SELECT event_id, event_type, value FROM events
       WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) AND event_id % 3 = 0)""",
)
def r2_numbers(spark, sf):
    """Late rows at or below the cursor are skipped."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    half = events.agg(F.floor(F.max("event_id") / 2)).scalar()
    held = events.where((F.col("event_id") <= half) & (F.col("event_id") % 3 == 0))
    return refresh.incremental_append(held, events, "event_id").frame


@query(
    "R3_incremental_text",
    """WITH held AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')
       SELECT * FROM held UNION SELECT * FROM customer
       WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM held)""",
)
def r3(spark, sf):
    rows = table(spark, sf, "customer")
    return refresh.incremental_append(rows.where("c_mktsegment <> 'BUILDING'"), rows, "c_mktsegment").frame


@query(
    "R4_full_fallback",
    """SELECT 'full_fallback' AS mode, 'The columns changed (new: o_orderstatus).' AS reason,
              CAST(count(*) AS BIGINT) AS rows_added, CAST(NULL AS VARCHAR) AS cursor_column, CAST(NULL AS VARCHAR) AS cursor_value FROM orders""",
)
def r4(spark, sf):
    held = _held(spark, sf).drop("o_orderstatus")
    return refresh.append_details(refresh.incremental_append(held, _orders(spark, sf), "o_orderdate"), held)


def _dated_catalog(sf):
    def step(operation: str, **options) -> tuple[dict, ...]:
        return ({"kind": "transform", "operation": operation, "options": options},)

    records = [
        DatasetRecord("orders", "upload", f"{sf}/orders.parquet"),
        DatasetRecord("dated", "derived", parent_dataset_id="orders", steps=step("create_date_parts", column="o_orderdate", prefix="o")),
        DatasetRecord("slim", "derived", parent_dataset_id="dated", steps=step("keep_columns", columns=["o_year", "o_orderpriority"])),
        DatasetRecord("unique", "derived", parent_dataset_id="slim", steps=step("drop_duplicates")),
    ]
    return {r.id: r for r in records}


_DATED = "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS o_year, o_orderpriority FROM orders"


@query("R5_rebuild_refresh", _DATED)
def r5(spark, sf):
    catalog = _dated_catalog(sf)
    outcome = refresh_managed(spark, ManagedDataset(catalog["unique"], scratch_path(spark, "rebuilt")), catalog=catalog)
    return current(spark, outcome.dataset)


@query("R5_stored_lineage", _DATED)
def r5_stored(spark, sf):
    """The second refresh finds what the first one built."""
    catalog, store = _dated_catalog(sf), scratch_path(spark, "results")
    dataset = ManagedDataset(catalog["unique"], scratch_path(spark, "rebuilt"))
    for _ in range(2):
        dataset = refresh_managed(spark, dataset, catalog=catalog, store=store).dataset
    return current(spark, dataset)


@query(
    "R6_schema_drift",
    """WITH c AS (SELECT user_id AS dataset, event_type AS "column", ts < TIMESTAMP '2024-01-16' AS old, max(CASE WHEN value > 40 THEN 'double' ELSE 'bigint' END) AS t
                  FROM events GROUP BY 1, 2, 3),
            b AS (SELECT * FROM c WHERE old), a AS (SELECT * FROM c WHERE NOT old)
       SELECT CAST(coalesce(b.dataset, a.dataset) AS VARCHAR) AS dataset, coalesce(b."column", a."column") AS "column",
              CASE WHEN b.t IS NULL THEN 'added' WHEN a.t IS NULL THEN 'removed' ELSE 'type_changed' END AS change, b.t AS previous, a.t AS current
       FROM b FULL JOIN a ON a.dataset = b.dataset AND a."column" = b."column" WHERE a.t IS DISTINCT FROM b.t""",
)
def r6(spark, sf):
    """Two catalogs derived from the events: users are datasets, kinds of event their columns, before and after a day."""
    seen = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("dataset"),
        F.col("event_type").alias("column"),
        (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))).alias("old"),
        F.when(F.col("value") > 40, "double").otherwise("bigint").alias("dtype"),
    )
    fields = seen.groupBy("dataset", "column", "old").agg(F.max("dtype").alias("dtype"))
    return refresh.schema_changes(fields.where("old").drop("old"), fields.where("NOT old").drop("old"))


@query(
    "R7_freshness",
    """WITH cat AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'upload' ELSE 'derived' END AS source_type,
                           CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 3 END AS parent, o_orderdate AS updated_at FROM orders)
       SELECT c.id, CASE WHEN c.source_type = 'upload' AND c.updated_at + INTERVAL (c.id % 5 - 2) DAY > c.updated_at THEN 'stale_source'
                         WHEN c.source_type = 'derived' AND p.updated_at > c.updated_at THEN 'upstream_changed' ELSE 'current' END AS status
       FROM cat c LEFT JOIN cat p ON p.id = c.parent""",
)
def r7(spark, sf):
    """A catalog derived from the orders: every third one is a source, the others depend on it."""
    key = F.col("o_orderkey")
    catalog = table(spark, sf, "orders").select(
        key.alias("id"),
        F.when(key % 3 == 0, "upload").otherwise("derived").alias("source_type"),
        F.when(key % 3 != 0, key - key % 3).alias("parent_dataset_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_refreshed_at"),
    )
    times = catalog.select("id", F.expr("updated_at + make_dt_interval(cast(id % 5 - 2 as int))").alias("modified_at"))
    return refresh.freshness(catalog, times)


@query(
    "R8_sensitivity_catalog",
    """WITH c AS (SELECT CAST(event_id // 3 AS VARCHAR) AS dataset, event_type AS e, value > 20 AS num FROM events)
       SELECT dataset, CASE WHEN bool_or(e = 'purchase') THEN 'Restricted' WHEN bool_or(e IN ('signup', 'click')) THEN 'Confidential'
                            WHEN bool_or(num) THEN 'General' ELSE 'Public' END AS label,
              CASE WHEN bool_or(e = 'purchase') THEN 'card_number, credit_card' WHEN bool_or(e = 'signup') AND bool_or(e = 'click') THEN 'email, phone'
                   WHEN bool_or(e = 'signup') THEN 'email' WHEN bool_or(e = 'click') THEN 'phone' ELSE '' END AS hints
       FROM c GROUP BY dataset""",
)
def r8_catalog(spark, sf):
    """A catalog derived from the events: three columns per dataset, named by the kind of event."""
    kind = F.col("event_type")
    columns = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 3).cast("string").alias("dataset"),
        F.when(kind == "purchase", "Credit_Card_Number").when(kind == "signup", "e_mail_or_email").when(kind == "click", "telephone")
        .otherwise(kind).alias("column"),
        F.when(F.col("value") > 20, "double").otherwise("string").alias("dtype"),
    )
    return governance.sensitivity_labels(columns)


@query(
    "R9_quality_risk",
    """SELECT event_type AS dataset, CAST(count(*) FILTER (value > 60) AS BIGINT) AS warnings,
              CASE WHEN count(*) FILTER (value > 60) >= 3 THEN 'High' WHEN count(*) FILTER (value > 60) >= 1 THEN 'Medium' ELSE 'Low' END AS quality_risk
       FROM events GROUP BY 1""",
)
def r9(spark, sf):
    alerts = table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.when(F.col("value") > 60, "warning").otherwise("info").alias("severity")
    )
    return governance.quality_risk(alerts)


@query(
    "R9_alert_risk",
    """WITH w AS (SELECT 'orders' AS dataset, CASE WHEN (SELECT count(*) FROM orders) > (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) THEN 1 ELSE 0 END AS k
                  UNION ALL SELECT 'documents', CASE WHEN (SELECT count(*) FROM documents) > (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) THEN 1 ELSE 0 END)
       SELECT dataset, CAST(k AS BIGINT) AS warnings, CASE WHEN k >= 3 THEN 'High' WHEN k >= 1 THEN 'Medium' ELSE 'Low' END AS quality_risk FROM w""",
)
def r9_alerts(spark, sf):
    parts = [profile.quality_alerts(table(spark, sf, t)).withColumn("dataset", F.lit(t)) for t in ("orders", "documents")]
    return governance.quality_risk(parts[0].unionByName(parts[1]))


@query("R2_stream_refresh", "SELECT * FROM events")
def r2_stream(spark, sf):
    """Half of the events are held as a managed version; the rest arrives in four loads, the newest first, a few files per batch."""
    events = table(spark, sf, "events")
    base, landing = scratch_path(spark, "managed-events"), scratch_path(spark, "landing")
    top = events.agg(F.max("event_id")).first()[0] or 0
    append_batch(events.where(F.col("event_id") <= top // 2), base, "event_id")
    for part in (3, 2, 1, 0):
        events.where(F.floor(F.col("event_id") * 4 / (top + 1)) == part).write.mode("append").parquet(landing)
    refresh_available(spark, landing, events.schema, base, "event_id", scratch_path(spark, "progress"), max_files_per_batch=2)
    return snapshot(spark, base)
