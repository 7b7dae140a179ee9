"""Preparation, filters, policies, sampling and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.functions.columns import role_listing
from prismtally.operators import filters, prepare, transforms
from prismtally.plans.replay import DatasetRecord, JoinSpec, rebuild
from prismtally.queries.registry import query, table


@query("P1_drop_empty", "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <> 1")
def p1(spark, sf):
    kept = F.col("l_linenumber") != 1
    raw = table(spark, sf, "lineitem").select(
        F.when(kept, F.col("l_orderkey")).alias(" l_orderkey "),
        F.when(kept, F.col("l_returnflag")).alias("l_returnflag"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit(float("nan")).alias("no_number"),
    )
    cleaned = prepare.strip_column_names(prepare.normalise_missing(raw))
    return prepare.drop_empty_rows(prepare.drop_empty_columns(cleaned))


@query(
    "P1_prepare",
    """SELECT o_orderkey AS key, round(o_totalprice, 2) AS price, o_orderdate AS placed, o_orderpriority AS priority
       FROM orders WHERE o_orderkey % 11 <> 0""",
)
def p1_prepare(spark, sf):
    """Everything at once: padded names, an empty column, empty rows, numbers and dates as text."""
    kept = F.col("o_orderkey") % 11 != 0
    raw = table(spark, sf, "orders").select(
        F.when(kept, F.col("o_orderkey").cast("string")).alias(" key"),
        F.when(kept, F.format_number("o_totalprice", 2)).alias("price "),
        F.when(kept, F.date_format("o_orderdate", "MM/dd/yyyy")).alias("placed"),
        F.when(kept, F.col("o_orderpriority")).alias("priority"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return prepare.prepare(raw).withColumn("price", F.round("price", 2))


@query(
    "P2_coerce_numbers",
    """SELECT l_orderkey, CASE WHEN l_linenumber <> 7 THEN round(l_extendedprice, 2) END AS price_text,
              CAST(l_linenumber AS BIGINT) AS line_text, l_returnflag FROM lineitem""",
)
def p2(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.format_number("l_extendedprice", 2)).alias("price_text"),
        F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("line_text"),
        "l_returnflag",
    )
    return prepare.coerce_text(raw).withColumn("price_text", F.round("price_text", 2))


@query(
    "P3_coerce_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS us_date,
              CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mostly
       FROM orders""",
)
def p3(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("us_date"),
        F.when(F.col("o_orderkey") % 3 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("mostly"),
    )
    return prepare.coerce_text(raw)


@query(
    "P4_chart_subset",
    """SELECT l_returnflag, CASE WHEN l_linenumber <= 6 THEN l_quantity END AS quantity_text,
              printf('%.2f', l_extendedprice + 1000000) AS price_text, l_shipdate AS ship_text
       FROM lineitem""",
)
def p4(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_returnflag",
        F.when(F.col("l_linenumber") <= 6, F.col("l_quantity").cast("string")).alias("quantity_text"),
        F.format_number(F.col("l_extendedprice") + 1000000, 2).alias("price_text"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship_text"),
    )
    subset = prepare.prepare_chart_subset(raw, ["l_returnflag", "quantity_text", "price_text", "ship_text"])
    # Prices with thousands commas stay text here, unlike in P2.
    return subset.withColumn("price_text", F.regexp_replace("price_text", ",", ""))


@query("P5_keep_columns", "SELECT l_shipdate, l_orderkey, l_extendedprice FROM lineitem")
def p5(spark, sf):
    return filters.keep_columns(table(spark, sf, "lineitem"), ["l_shipdate", "l_orderkey", "l_extendedprice"])


@query("P6_filter_equals", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
def p6(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return filters.filter_equals(filters.filter_equals(rows, "o_orderstatus", "F"), "o_custkey", "7")


@query(
    "P7_filter_dates",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'""",
)
def p7(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return filters.filter_dates(rows, "o_orderdate", "1996-01-01", "1996-12-31")


@query(
    "P8_row_policies",
    """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
       WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 4)""",
)
def p8(spark, sf):
    policies = filters.clean_policies(
        [
            {"user": "viewer", "column": "c_mktsegment", "allowed_values": ["BUILDING", "MACHINERY"]},
            {"user": "viewer", "column": "c_nationkey", "allowed_values": [1, 2, 3, 4, "x"]},
            {"user": "viewer", "column": "not_there", "allowed_values": ["a"]},
            {"user": "viewer", "column": "c_name", "allowed_values": []},
            {"user": "someone", "column": "c_custkey", "allowed_values": ["1"]},
        ]
    )
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return filters.apply_row_policies(rows, policies, "viewer", owner="owner")


@query(
    "P8_policy_table",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def p8_table(spark, sf):
    policies = (
        table(spark, sf, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.lit("viewer").alias("user"), F.lit("o_custkey").alias("column"), F.col("c_custkey").cast("string").alias("value"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return filters.apply_policy_table(rows, policies, "viewer", ["o_custkey"])


def _sample_sql(columns: str, source: str, key: str, share: float) -> str:
    digest = f"substr(md5(concat_ws('|', '42', {key})), 1, 15)"
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {digest}, {key}) AS place, count(*) OVER () AS n FROM {source})
               WHERE place <= greatest(1, floor(n * {share}))"""


@query("P9_sample_exact", _sample_sql("l_orderkey, l_linenumber, l_quantity", "lineitem", "l_orderkey, l_linenumber", 0.1))
def p9(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return filters.sample_exact(rows, 10, key=["l_orderkey", "l_linenumber"])


@query("P9_sampled_rows", _sample_sql("* EXCLUDE (place, n)", "orders", "o_orderkey", 0.05))
def p9_rows(spark, sf):
    return filters.sample_exact(table(spark, sf, "orders"), 5, key=["o_orderkey"])


@query(
    "P10_column_roles",
    "\nUNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{role}' AS role, count({c}) AS present FROM lineitem"""
        for i, (c, role) in enumerate(
            [(c, "numeric") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
            + [("l_returnflag", "categorical"), ("l_linestatus", "categorical"), ("l_shipdate", "datetime")]
        )
    ),
)
def p10(spark, sf):
    """Chart roles of the columns that hold something, with how many cells do."""
    rows = table(spark, sf, "lineitem")
    present = rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns]).unpivot([], rows.columns, "column", "present")
    return role_listing(rows).join(present, "column").select("position", "column", "role", "present")


@query("T1_drop_duplicates", "SELECT DISTINCT text, lang FROM documents")
def t1(spark, sf):
    return transforms.apply_transform(table(spark, sf, "documents").select("text", "lang"), "drop_duplicates")


@query(
    "T2_trim_text",
    r"SELECT doc_id, regexp_replace(regexp_replace(text, '^[\s\x{85}\p{Z}]+', ''), '[\s\x{85}\p{Z}]+$', '') AS text, lang FROM documents",
)
def t2(spark, sf):
    padded = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("\t  \n"), "text", F.lit(" \r\n　")).alias("text"), F.concat("lang", F.lit("\t")).alias("lang")
    )
    return transforms.apply_transform(padded, "trim_text")


@query(
    "T3_fill_median",
    """WITH gaps AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value,
                            CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id FROM events)
       SELECT event_id, round(coalesce(value, (SELECT median(value) FROM gaps)), 6) AS value,
              CAST(coalesce(user_id, (SELECT median(user_id) FROM gaps)) AS DOUBLE) AS user_id FROM gaps""",
)
def t3(spark, sf):
    gaps = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"),
    )
    filled = transforms.apply_transform(gaps, "fill_numeric_median")
    return filled.select("event_id", F.round("value", 6).alias("value"), F.col("user_id").cast("double").alias("user_id"))


@query("T4_drop_sparse", "SELECT l_orderkey, CASE WHEN l_linenumber > 2 THEN l_tax END AS some_tax FROM lineitem")
def t4(spark, sf):
    gaps = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("some_tax"),
        F.when(F.col("l_linenumber") > 5, F.col("l_discount")).alias("little_discount"),
    )
    return transforms.apply_transform(gaps, "drop_sparse_columns", {"threshold": 40})


@query(
    "T5_date_parts",
    """SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS placed_year,
              CAST(quarter(o_orderdate) AS INTEGER) AS placed_quarter, CAST(month(o_orderdate) AS INTEGER) AS placed_month,
              monthname(o_orderdate) AS placed_month_name FROM orders""",
)
def t5(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return transforms.apply_transform(rows, "create_date_parts", {"column": "o_orderdate", "prefix": "placed"})


@query(
    "T6_calculated_column",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS rebate,
              round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 6) AS discount_per_tax,
              round(l_quantity - 10, 4) AS above_ten, round(l_extendedprice + l_tax, 4) AS total FROM lineitem""",
)
def t6(spark, sf):
    rows = table(spark, sf, "lineitem")
    steps = [
        {"new_column": "rebate", "left": "l_extendedprice", "operator": "*", "right_value": "l_discount"},
        {"new_column": "discount_per_tax", "left": "l_discount", "operator": "/", "right_value": "l_tax"},
        {"new_column": "above_ten", "left": "l_quantity", "operator": "-", "right_mode": "constant", "right_value": "10"},
        {"new_column": "total", "left": "l_extendedprice", "operator": "+", "right_value": "l_tax"},
    ]
    for step in steps:
        rows = transforms.apply_transform(rows, "create_calculated_column", step)
    return rows.select(
        "l_orderkey", "l_linenumber", F.round("rebate", 4).alias("rebate"),
        F.round("discount_per_tax", 6).alias("discount_per_tax"), F.round("above_ten", 4).alias("above_ten"),
        F.round("total", 4).alias("total"),
    )


def _catalog(sf: str) -> dict[str, DatasetRecord]:
    def derived(name: str, parent: str, operation: str, options: dict) -> DatasetRecord:
        step = {"kind": "transform", "operation": operation, "options": options}
        return DatasetRecord(name, "derived", parent_dataset_id=parent, steps=(step,))

    records = [
        DatasetRecord("orders", "upload", f"{sf}/orders.parquet"),
        DatasetRecord("customer", "upload", f"{sf}/customer.parquet"),
        derived("dated", "orders", "create_date_parts", {"column": "o_orderdate", "prefix": "o"}),
        derived(
            "priced", "dated", "create_calculated_column",
            {"new_column": "net", "left": "o_totalprice", "operator": "/", "right_mode": "constant", "right_value": "1.25"},
        ),
        DatasetRecord("joined", "joined", join=JoinSpec("priced", "customer", "o_custkey", "c_custkey", "inner")),
        DatasetRecord("again", "rebuilt", parent_dataset_id="joined"),
        derived(
            "final", "again", "keep_columns",
            {"columns": ["o_orderkey", "o_year", "o_month_name", "net", "c_name", "c_mktsegment"]},
        ),
    ]
    return {r.id: r for r in records}


@query(
    "T7_replay",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_year, monthname(o_orderdate) AS o_month_name,
              round(o_totalprice / 1.25, 4) AS net, c_name, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def t7(spark, sf):
    return rebuild(spark, _catalog(sf), "final").withColumn("net", F.round("net", 4))
