"""Semantics, keys, joins, policies, filter options, governance."""

import datetime as dt

import pytest

from prismtally.operators import filters, governance, joins, profile, relationships, semantics
from prismtally.operators.prepare import prepare


def profiles(df, overrides=None):
    return {r["name"]: r for r in semantics.infer_semantics(df, overrides).collect()}


def orders(spark):
    rows = [(1001 + i, dt.datetime(2026, 1, 1 + i), "NSEW"[i], 120.0 + i * 30, 0.1 * (i + 1)) for i in range(4)]
    return spark.createDataFrame(
        rows, "order_id long, order_date timestamp_ntz, region string, revenue double, conversion_rate double"
    )


def test_roles_families_and_grain(spark):
    p = profiles(orders(spark))
    assert p["order_id"]["semantic_role"] == "identifier"
    assert (p["revenue"]["metric_family"], p["revenue"]["default_aggregation"]) == ("currency", "sum")
    assert p["conversion_rate"]["default_aggregation"] == "average" and not p["conversion_rate"]["is_additive"]
    assert p["order_date"]["time_grain"] == "daily" and p["order_date"]["semantic_role"] == "datetime"
    assert p["region"]["hierarchy"]["next_levels"] == ["country", "state", "province", "city", "postal", "zip"]


def test_booleans_are_numbers_and_dates_by_name(spark):
    df = spark.createDataFrame([(True, "x", 1), (False, "y", 5), (True, "z", 2)], "is_paid boolean, day_name string, week int")
    p = profiles(df)
    assert (p["is_paid"]["semantic_role"], p["is_paid"]["metric_family"]) == ("measure", "boolean")
    assert p["day_name"]["semantic_role"] == "datetime" and p["day_name"]["time_grain"] == "unknown"
    assert p["week"]["semantic_role"] == "datetime"


@pytest.mark.parametrize("days, grain", [(0.01, "sub-hourly"), (0.5, "hourly"), (1, "daily"), (7, "weekly"), (30, "monthly"), (91, "quarterly"), (365, "yearly")])
def test_grains(spark, days, grain):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(days=days * i),) for i in range(6)]
    df = spark.createDataFrame(rows, "at timestamp_ntz")
    assert semantics.time_grain(df, "at").first()["time_grain"] == grain


def test_dataset_model(spark):
    rows = [(i, dt.datetime(2026, 1, i), "NSEW"[i - 1], 100 + 20 * i, 10 + i * i) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "order_id long, order_date timestamp_ntz, region string, sales long, profit long")
    model = semantics.dataset_model(semantics.infer_semantics(df), 4).first()
    assert (model["dataset_role"], model["row_grain"], model["measures"]) == ("fact", "order_id", 2)
    assert model["primary_date_column"] == "order_date"


def test_overrides(spark):
    df = spark.createDataFrame([(100.0, "N"), (250.0, "S"), (80.0, "E"), (90.0, "W")], "revenue double, region string")
    found = semantics.infer_semantics(df, {"revenue": {"certified": True, "business_name": "Net", "unknown": 1, "description": ""}})
    row = {r["name"]: r for r in found.collect()}["revenue"]
    assert (row["override_source"], row["business_name"], row["certified"]) == ("manual", "Net", True)
    model = semantics.dataset_model(found, 4).first()
    assert model["certified_metrics"] == ["revenue"] and model["manual_override_count"] == 1


def test_sketches_instead_of_exact_counts(spark):
    p = {r["name"]: r for r in semantics.infer_semantics(orders(spark), approximate=True).collect()}
    assert p["order_id"]["semantic_role"] == "identifier"


def test_key_candidates(spark):
    df = spark.createDataFrame([("c1", "N", 10), ("c2", "N", 10), ("c3", "S", 10), ("c4", "S", 10)], "customer_id string, region string, sales long")
    first = relationships.key_candidates(df).first()
    assert (first["column"], first["role_hint"], first["score"]) == ("customer_id", "primary_key", 1.0)
    assert relationships.key_candidates(df, approximate=True).first()["column"] == "customer_id"


def test_name_similarity():
    assert relationships.name_similarity("Customer_ID", "customer id") == 1.0
    assert 0 < relationships.name_similarity("custkey", "c_custkey") < 1


def test_relationships(spark):
    a = spark.createDataFrame([(f"k{i}", i * 1.5) for i in range(20)], "customer_id string, amount double")
    b = spark.createDataFrame([(f"k{i} ", "x") for i in range(10)], "customer_id string, segment string")
    top = relationships.suggest_relationships({"a": a, "b": b}).first()
    assert (top["left_column"], top["right_column"], top["overlap_score"], top["recommended_join"]) == ("customer_id", "customer_id", 1.0, "left")


def test_overlap_of_many_columns(spark):
    """More columns than bits in one word."""
    frames = [(spark.createDataFrame([(str(v),) for v in range(i, i + 4)], "v string"), "v") for i in range(63)]
    found = {(r["i"], r["j"]): r["shared"] for r in relationships.overlaps(frames).collect()}
    assert found[(0, 1)] == 3 and found[(58, 61)] == 1 and found[(60, 62)] == 2 and (0, 4) not in found


def test_join_on_padded_keys(spark):
    left = spark.createDataFrame([("A1 ", 1), ("A2", 2), ("A3", 3)], "customer_code string, sales long")
    right = spark.createDataFrame([("A1", "x"), (" A2", "y"), ("A3", "z")], "customer_code string, segment string")
    joined = joins.join_on_keys(left, right, "customer_code", "customer_code", "inner")
    assert joined.count() == 3 and "segment" in joined.columns and "customer_code_related" in joined.columns


def test_missing_keys_match_nothing_and_outer_keeps_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (9, "z")], "k int, r string")
    got = {(r["l"], r["r"]) for r in joins.join_on_keys(left, right, "k", "k", "outer").collect()}
    assert got == {("a", "x"), ("b", None), (None, "y"), ("c", None), (None, "z")}
    assert joins.join_on_keys(left, right, "k", "k", "inner").count() == 1


def test_keys_that_do_not_parse_compare_as_text(spark):
    keys = lambda mark: [(str(k),) for k in range(100)] + [(f"{mark}{k}",) for k in range(8)]
    left, right = spark.createDataFrame(keys("x"), "k string"), spark.createDataFrame(keys("x") + keys("y")[100:], "k string")
    assert joins.join_on_keys(left, right, "k", "k", "left").count() == 108
    assert joins.join_on_keys(left, right, "k", "k", "inner").count() == 108
    assert joins.join_on_keys(left, right, "k", "k", "outer").count() == 116


def test_join_arguments(spark):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = left
    with pytest.raises(ValueError, match="left, inner, outer"):
        joins.join_on_keys(left, right, "k", "k", "cross")
    with pytest.raises(ValueError, match="right side"):
        joins.join_on_keys(left, right, "k", "nope")


def test_join_of_date_text_with_dates(spark):
    left = spark.createDataFrame([("01/02/2026", 1), ("01/03/2026", 2)], "d string, v int")
    right = spark.createDataFrame([(dt.datetime(2026, 1, 2), "x")], "day timestamp_ntz, w string")
    assert [(r["v"], r["w"]) for r in joins.join_on_keys(left, right, "d", "day", "inner").collect()] == [(1, "x")]


def test_join_with_a_hot_key(spark):
    """A third of the rows share one key; all of them come out."""
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k long, v long")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 3000, 2)], "k long, name string")
    joined = joins.join_on_keys(left, right, "k", "k", "left")
    assert joined.count() == 3000 and joined.where("k = 0 and name = '0'").count() == 1000


def test_row_policy(spark):
    df = spark.createDataFrame([("North", 100), ("South", 200), ("North", 300)], "region string, revenue long")
    policies = filters.clean_policies([{"user": "viewer", "column": "region", "allowed_values": ["North"]}, {"user": ""}, "x"])
    seen = filters.apply_row_policies(df, policies, "viewer", owner="owner")
    assert sorted(r["revenue"] for r in seen.collect()) == [100, 300]
    assert filters.apply_row_policies(df, policies, "owner", owner="owner").count() == 3
    assert filters.apply_row_policies(df, policies, "other", owner="owner").count() == 3
    assert profile.overview(seen).first()["rows"] == 2


def test_long_policies_become_a_semi_join(spark, monkeypatch):
    monkeypatch.setattr(filters, "INLINE_POLICY_VALUES", 1)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    policies = [filters.RowPolicy("v", "g", ("a", "b"))]
    assert filters.apply_row_policies(df, policies, "v").count() == 2


def test_text_comparison_of_numbers(spark):
    df = spark.createDataFrame([(7, 7.0), (70, 7.5)], "i int, d double")
    assert filters.filter_equals(df, "i", "7").count() == 1
    assert filters.filter_equals(df, "i", "07").count() == 0
    assert filters.filter_equals(df, "i", 99999999999).count() == 0
    assert filters.filter_equals(df, "d", "7.0").count() == 1
    assert filters.filter_equals(df, "nope", "1").count() == filters.filter_equals(df, "i", "__all__").count() == 2


def test_exact_sample(spark):
    df = spark.range(1000)
    sample = filters.sample_exact(df, 12.5, key=["id"])
    again = filters.sample_exact(df.repartition(7), 12.5, key=["id"])
    ids = {r["id"] for r in sample.collect()}
    assert len(ids) == 125 and ids == {r["id"] for r in again.collect()}
    same = df.selectExpr("1 AS k", "id")
    assert filters.sample_exact(same, 10, key=["k"]).count() == 100
    assert filters.sample_exact(df, 0.01).count() == 1 and filters.sample_exact(df, 100).count() == 1000


def test_filter_options(spark):
    df = spark.createDataFrame(
        [("North", dt.datetime(2026, 1, 1), 1), ("North", dt.datetime(2026, 1, 2), 2), ("South", dt.datetime(2026, 1, 3), 5)],
        "region string, observed_at timestamp_ntz, revenue long",
    )
    rows = profile.filter_options(df, semantics.infer_semantics(df)).orderBy("rank").collect()
    assert [r["value"] for r in rows if r["name"] == "region"] == ["North", "South"]
    assert [r["name"] for r in rows if r["role"] == "date"] == ["observed_at"]


def test_sensitivity(spark):
    rows = [("a", "customer_email", "string"), ("a", "revenue", "bigint"), ("b", "SSN", "string"), ("c", "v", "double"), ("d", "t", "string")]
    df = spark.createDataFrame(rows, "dataset string, column string, dtype string")
    labels = {r["dataset"]: r["label"] for r in governance.sensitivity_labels(df).collect()}
    assert labels == {"a": "Confidential", "b": "Restricted", "c": "General", "d": "Public"}


def test_prepare(spark):
    rows = [(" 1,200 ", "2026-01-05", "a", None, None), ("950", "2026-01-06", "b", None, float("nan")), ("oops", "2026-01-07", "c", None, 1.0)]
    rows += [(str(i), f"2026-02-0{i}", "d", None, 2.0) for i in range(1, 9)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "` price ` string, day string, name string, empty string, n double")
    out = prepare(df)
    assert dict(out.dtypes) == {"price": "double", "day": "timestamp_ntz", "name": "string", "n": "double"}
    assert out.count() == 11 and out.where("price = 1200").count() == 1 and out.where("n is null").count() == 2


def test_numbers_win_over_dates_and_whole_numbers_stay_whole(spark):
    df = spark.createDataFrame([("20260101", "1d"), ("20260102", "2d")], "code string, other string")
    assert dict(prepare(df).dtypes) == {"code": "bigint", "other": "string"}


def test_quality_alerts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "a int, b string")
    alerts = [(r["severity"], r["title"]) for r in profile.quality_alerts(df).orderBy("alert").collect()]
    assert alerts == [("warning", "Repeated rows"), ("warning", "Many gaps in 'b'")]
    clean = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    assert [r["severity"] for r in profile.quality_alerts(clean).collect()] == ["success"]
