"""Results of a lineage that are found again, and not found after a change."""

import os
import time

from pyspark.sql import functions as F

from prismtally.plans.replay import DatasetRecord, JoinSpec, Lineage, rebuild


def step(operation, **options):
    return ({"kind": "transform", "operation": operation, "options": options},)


def catalog(folder, columns=("k",)):
    records = [
        DatasetRecord("base", "upload", f"{folder}/base"),
        DatasetRecord("slim", "derived", parent_dataset_id="base", steps=step("keep_columns", columns=list(columns))),
        DatasetRecord("unique", "derived", parent_dataset_id="slim", steps=step("drop_duplicates")),
        DatasetRecord("both", "joined", join=JoinSpec("unique", "base", "k", "k", "inner")),
    ]
    return {r.id: r for r in records}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def reads(df):
    return sorted({f.rsplit("/", 2)[1] for f in df.inputFiles()})


def test_second_rebuild_reads_the_stored_rows(spark, folder):
    records = {**catalog(folder), "base": DatasetRecord("base", "upload", f"{folder}/base.parquet")}
    (spark.range(20).select((F.col("id") % 5).alias("k"), "id")).write.parquet(f"{folder}/base.parquet")
    store = f"{folder}/store"
    first = rebuild(spark, records, "unique", store)
    again = rebuild(spark, records, "unique", store)
    assert sorted(r["k"] for r in again.collect()) == [0, 1, 2, 3, 4] and len(os.listdir(store)) == 1
    assert reads(again) == ["rows"] == reads(first) and "Aggregate" not in plan(again)
    # A record above it starts from the stored one.
    above = Lineage(spark, records, store).frame("both")
    assert reads(above) == ["base.parquet", "rows"] and above.count() == 20
    assert reads(rebuild(spark, records, "unique")) == ["base.parquet"]


def test_changes_are_other_results(spark, folder):
    records = {**catalog(folder), "base": DatasetRecord("base", "upload", f"{folder}/base.parquet")}
    rows = spark.range(20).select((F.col("id") % 5).alias("k"), "id")
    rows.write.parquet(f"{folder}/base.parquet")
    store = f"{folder}/store"
    assert rebuild(spark, records, "unique", store).count() == 5
    before = Lineage(spark, records, store).fingerprint("unique")
    assert Lineage(spark, records, store).fingerprint("unique") == before
    time.sleep(0.01)
    rows.select((F.col("k") + 10).alias("k"), "id").write.mode("append").parquet(f"{folder}/base.parquet")
    assert Lineage(spark, records, store).fingerprint("unique") != before
    assert rebuild(spark, records, "unique", store).count() == 10
    wider = {**records, "slim": catalog(folder, ("k", "id"))["slim"]}
    assert rebuild(spark, wider, "unique", store).count() == 40 and len(os.listdir(store)) == 3


def test_rows_without_a_mark_are_written_again(spark, folder):
    records = {**catalog(folder), "base": DatasetRecord("base", "upload", f"{folder}/base.parquet")}
    spark.range(3).toDF("k").write.parquet(f"{folder}/base.parquet")
    lineage = Lineage(spark, records, f"{folder}/store")
    spark.range(99).write.parquet(f"{folder}/store/{lineage.fingerprint('unique')}/rows")
    assert rebuild(spark, records, "unique", f"{folder}/store").count() == 3
