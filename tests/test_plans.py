"""Shapes of physical plans: what must reach the scan, and what must not appear."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from prismtally.functions.frequencies import top_values, value_counts
from prismtally.operators import filters, joins, refresh

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
SLOW = {"I15_model_driver", "I17_dataset_summary", "I17_key_insights"}


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_no_pairing_of_everything(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    orders = read(spark, "orders")
    text = plan(filters.filter_dates(orders, "o_orderdate", "1996-01-01", "1996-12-31").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    text = plan(filters.filter_equals(orders, "o_custkey", "7"))
    assert "EqualTo(o_custkey,7)" in text
    policy = [filters.RowPolicy("v", "o_custkey", ("1", "2"))]
    assert "In(o_custkey, [1,2])" in plan(filters.apply_row_policies(orders, policy, "v"))


def test_cursor_reaches_the_scan(spark):
    orders = read(spark, "orders")
    held = orders.where(F.col("o_orderkey") < 100)
    assert "GreaterThan(o_orderkey,99)" in plan(refresh.delta_rows(held, orders, "o_orderkey"))
    assert "GreaterThan(o_orderdate," in plan(refresh.delta_rows(held, orders, "o_orderdate"))


def test_top_values_are_cut_before_the_shuffle(spark):
    text = plan(top_values(value_counts(read(spark, "orders"), ["o_orderpriority"]), 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_null_safe_join_is_an_equi_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(joins.join_on_keys(read(spark, "orders"), read(spark, "customer"), "o_custkey", "c_custkey"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "NestedLoop" not in text


@pytest.mark.parametrize("how", ["left", "inner", "outer"])
def test_hot_keys_are_split(spark, how):
    """A key that holds a third of the rows is cut into several tasks at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(0, 200_000, 1, 16)
        left = ids.select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        right = spark.range(0, 200_000, 2, 16).select(F.col("id").alias("k"), F.col("id").alias("w"))
        joined = joins.join_on_keys(left, right, "k", "k", how)
        rows = joined.collect()
        keys, names = [0 if i % 3 == 0 else i for i in range(200_000)], set(range(0, 200_000, 2))
        matched = sum(k in names for k in keys)
        assert len(rows) == {"left": 200_000, "inner": matched, "outer": 200_000 + len(names - set(keys))}[how]
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
