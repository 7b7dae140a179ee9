"""Distinct counts by type against plain sets, and key candidates whose columns a sketch rules out."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from prismtally.functions.distinct import SKETCH_ERROR, column_sketches, distinct_values
from prismtally.operators import profile, relationships

SCHEMA = "i int, n long, d date, t timestamp, z timestamp_ntz, f double, b boolean, s string, a array<int>, m decimal(10,2)"


def rows(count=3000, seed=5):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for _ in range(count):
        stamp = base + dt.timedelta(seconds=rng.randint(0, 5000), microseconds=rng.choice([0, 1]))
        out.append((
            rng.randint(-500, 500), rng.choice([rng.randint(-(2**63), 2**63 - 1), 0, -1]), stamp.date(), stamp, stamp, rng.choice([0.0, -0.0, rng.random(), float("nan")]),
            rng.random() < 0.5, rng.choice(["x" * 200, " y", "y ", f"k{rng.randint(0, 900)}"]), [rng.randint(0, 9)], Decimal(rng.randint(0, 99)) / 4,
        ))
        if rng.random() < 0.1:
            out[-1] = tuple(None if rng.random() < 0.5 else v for v in out[-1])
    return out


def test_counts_by_type(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = {r["column"]: r["unique"] for r in distinct_values(df, df.columns).collect()}
    for name, values in zip(df.columns, zip(*data)):
        kept = {str(v) if isinstance(v, list) else v for v in values if v is not None and v == v}
        assert got[name] == len(kept), name
    stripped = distinct_values(df, ["s"], stripped=True).first()["unique"]
    assert stripped == got["s"] - 1
    assert distinct_values(df, []).count() == 0 and distinct_values(df.limit(0), df.columns).count() == 0
    estimates = {r["column"]: r["estimate"] for r in column_sketches(df).collect()}
    assert all(abs(estimates[c] - got[c]) <= SKETCH_ERROR * got[c] + 1 for c in got if c not in "sf")


def test_dense_ids_are_words_before_the_shuffle(spark):
    df = spark.range(100_000).repartition(1)
    plan = distinct_values(df, ["id"])
    assert plan.first()["unique"] == 100_000
    words = df.select(F.shiftright("id", 6).alias("w")).distinct().count()
    assert words == 1563


def test_key_candidates_count_only_what_may_pass(spark, monkeypatch):
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("group_no"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit(None).cast("string").alias("empty"))
    asked = []
    real = relationships.distinct_values

    def watched(frame, columns, **more):
        asked.append(list(columns))
        return real(frame, columns, **more)

    monkeypatch.setattr(relationships, "distinct_values", watched)
    got = {r["column"]: r for r in relationships.key_candidates(df).collect()}
    assert asked == [["id", "name"]] and set(got) == {"id", "name"}
    assert got["id"]["unique_count"] == 20_000 and got["id"]["role_hint"] == "primary_key"
    assert relationships.key_candidates(df.select("group_no", "empty")).count() == 0


def test_samples_are_the_smallest_texts(spark):
    df = spark.createDataFrame([("b", 3, None), ("a", 20, None), ("a", 1, None), (None, 100, None)], "s string, n int, e string")
    assert {r["name"]: r["samples"] for r in profile.sample_values(df).collect()} == {"s": ["a", "b"], "n": ["1", "100", "20"]}


def related(spark):
    """Three datasets of ids, some of which share a part of their values."""
    a = spark.range(40_000).select(F.col("id").alias("a_id"), (F.col("id") * 1_000_003 + 5).alias("a_code"))
    b = spark.range(30_000).select((F.col("id") + 10_000).alias("b_id"), F.concat(F.lit("x"), F.col("id")).alias("b_key"))
    c = spark.range(3000).select(F.col("id").alias("c_id"), F.concat(F.lit(" x"), F.col("id") * 10).alias("c_key"))
    return {"a": a, "b": b, "c": c}


def test_sketches_lose_no_pair_that_values_would_give(spark, monkeypatch):
    datasets = related(spark)
    read = []
    real = relationships.overlaps
    monkeypatch.setattr(relationships, "overlaps", lambda columns: read.append([c for _, c in columns]) or real(columns))
    got = sorted(map(tuple, relationships.suggest_relationships(datasets).collect()))
    assert {(r[1], r[3]) for r in got} == {("a_id", "b_id"), ("a_id", "c_id"), ("b_key", "c_key")}
    assert "a_code" not in read[0] and len(read[0]) < 6
    monkeypatch.setattr(relationships, "comparable", lambda found, sketches: list(range(len(found))))
    assert sorted(map(tuple, relationships.suggest_relationships(datasets).collect())) == got
    lonely = {"a": datasets["a"].select("a_code"), "c": datasets["c"].select("c_key")}
    assert relationships.suggest_relationships(lonely).count() == 0
