"""Sources and sinks (S1-S12). Files of other formats are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.operators.profile import preview
from prismtally.operators.transforms import create_calculated_column
from prismtally.plans.workbench import export_query
from prismtally.queries.registry import query, table
from prismtally.session import scratch_path
from prismtally.sources.readers import explode_json, flatten_deep, flatten_json_text, read_dataset
from prismtally.sources.writers import write_csv, write_version


@query("S1_read_by_extension", "SELECT * FROM supplier")
def s1(spark, sf):
    return read_dataset(spark, f"{sf}/supplier.parquet")


@query(
    "S2_csv_scan",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def s2(spark, sf):
    path = scratch_path(spark, "customer")
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return read_dataset(spark, path, "csv")


_LINEITEM = "l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query("S3_tsv_scan", f"SELECT {_LINEITEM}, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem")
def s3(spark, sf):
    path = scratch_path(spark, "lineitem")
    rows = table(spark, sf, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    back = read_dataset(spark, path, "tsv")
    return back.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


@query(
    "S4_json_nested",
    'SELECT o_orderkey AS key, o_custkey AS "customer.key", o_orderstatus AS "state.code", '
    'o_totalprice AS "state.amount.total" FROM orders',
)
def s4(spark, sf):
    path = scratch_path(spark, "orders")
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.struct(F.col("o_custkey").alias("key")).alias("customer"),
        F.struct(
            F.col("o_orderstatus").alias("code"), F.struct(F.col("o_totalprice").alias("total")).alias("amount")
        ).alias("state"),
    ).write.json(path)
    return read_dataset(spark, path, "json").select("key", "`customer.key`", "`state.code`", "`state.amount.total`")


@query("S5_json_lines", "SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM events")
def s5(spark, sf):
    path = scratch_path(spark, "events")
    table(spark, sf, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).write.json(path)
    return read_dataset(spark, path, "jsonl").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("S6_parquet_scan", "SELECT * FROM orders")
def s6(spark, sf):
    return read_dataset(spark, f"{sf}/orders.parquet")


@query(
    "S8_flatten_json",
    "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events",
)
def s8(spark, sf):
    """The texts tell their own schema."""
    return flatten_json_text(table(spark, sf, "events"), "props")


@query(
    "S8_explode_json",
    """WITH j AS (SELECT event_id, user_id, event_type, ts FROM events),
            p AS (SELECT event_id, unnest([0, 1, 2]) AS i, user_id, event_type, ts FROM j)
       SELECT event_id, CAST(i AS INTEGER) AS doc_index, CAST(NULL AS VARCHAR) AS doc_key,
              CASE i WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type ELSE '{"user":' || user_id || '}' END AS doc_value
       FROM p WHERE i < 1 + event_id % 3""",
)
def s8_long(spark, sf):
    """Lists of one to three elements of different types, made of the events, in long form."""
    user = F.col("user_id").cast("string")
    parts = F.array(user, F.concat(F.lit('"'), "event_type", F.lit('"')), F.concat(F.lit('{"user":'), user, F.lit("}")))
    listed = F.concat(F.lit('{"list":['), F.array_join(F.slice(parts, F.lit(1), (1 + F.col("event_id") % 3).cast("int")), ","), F.lit("]}"))
    return explode_json(table(spark, sf, "events").select("event_id", listed.alias("doc")), "doc", "$.list")


@query(
    "S8_flatten_lists",
    """SELECT l_orderkey, l_linenumber, l_quantity AS parts_0_qty, l_tax AS parts_0_rate_tax,
              CASE WHEN l_linenumber > 3 THEN l_extendedprice END AS parts_1_qty,
              CASE WHEN l_linenumber > 3 THEN l_discount END AS parts_1_rate_tax FROM lineitem""",
)
def s8_lists(spark, sf):
    def part(qty: str, tax: str):
        return F.struct(F.col(qty).alias("qty"), F.struct(F.col(tax).alias("tax")).alias("rate"))

    one = F.array(part("l_quantity", "l_tax"))
    two = F.array(part("l_quantity", "l_tax"), part("l_extendedprice", "l_discount"))
    nested = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 3, two).otherwise(one).alias("parts")
    )
    return flatten_deep(nested)


@query(
    "S9_csv_sink",
    f"SELECT {_LINEITEM}, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, round(l_extendedprice * l_discount, 4) AS rebate FROM lineitem",
)
def s9(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    derived = create_calculated_column(rows, "rebate", "l_extendedprice", "*", "l_discount")
    back = read_dataset(spark, write_csv(derived, scratch_path(spark, "derived")), "csv")
    return back.withColumns({"rebate": F.round("rebate", 4), "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")})


@query(
    "S9_text_round_trip",
    """SELECT doc_id, '"' || text || '", ' || chr(13) || chr(10) || '""' AS text, lang, source, n_chars FROM documents""",
)
def s9_texts(spark, sf):
    """Every document, with quotes, separators and both kinds of line ends added."""
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('", \r\n""'))
    path = write_csv(table(spark, sf, "documents").withColumn("text", quoted), scratch_path(spark, "texts"))
    return read_dataset(spark, path, "csv")


@query("S10_managed_version", "SELECT * FROM orders")
def s10(spark, sf):
    return spark.read.parquet(write_version(table(spark, sf, "orders"), scratch_path(spark, "managed")))


@query(
    "S11_query_export",
    "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def s11(spark, sf):
    path = export_query(
        table(spark, sf, "orders"),
        "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM dataset GROUP BY 1 ORDER BY 3 DESC",
        scratch_path(spark, "export"),
    )
    return read_dataset(spark, path, "csv")


@query("S11_whole_export", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def s11_whole(spark, sf):
    """A result of far more rows than a preview shows."""
    sql = "SELECT o_orderkey, o_custkey, o_totalprice FROM dataset WHERE o_totalprice > 1000"
    return read_dataset(spark, export_query(table(spark, sf, "orders"), sql, scratch_path(spark, "whole")), "csv")


@query(
    "S12_preview",
    """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice,
              strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
       FROM orders ORDER BY o_orderkey LIMIT 10""",
)
def s12(spark, sf):
    return preview(table(spark, sf, "orders").orderBy("o_orderkey"), 10)
