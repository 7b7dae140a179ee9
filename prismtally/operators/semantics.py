"""Semantic model: roles, families, grains, hierarchies, overrides and the dataset model (M1-M9).

Statistics of all columns are Spark aggregates; the naming rules then run as column
expressions over one row per column.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtally.functions.columns import is_profiled_as_number, kind_of, moment, number, present
from prismtally.functions.distinct import distinct_values
from prismtally.functions.ordinals import gap_counts
from prismtally.functions.quantiles import quantiles
from prismtally.functions.rounding import nearest

# Substrings of column names (parts of words match on purpose).
GEOGRAPHY = ("country", "state", "city", "region", "postal", "zip", "latitude", "longitude", "lat", "lon")
IDENTIFIER = ("id", "uuid", "key", "code", "number", "no", "sku", "ticket")
CURRENCY = ("revenue", "sales", "price", "cost", "profit", "income", "amount", "spend", "expense", "gmv")
PERCENT = ("percent", "percentage", "pct", "rate", "ratio", "share", "conversion")
COUNT = ("count", "qty", "quantity", "volume", "units", "visits", "orders", "sessions", "users")
DATE = ("date", "time", "month", "year", "day", "week", "quarter")
TEXT = ("description", "comment", "notes", "message", "summary")
BOOLEAN = ("is_", "has_", "flag", "enabled", "active", "status")
HIERARCHIES = {
    "calendar": ("year", "quarter", "month", "week", "day", "date"),
    "geography": ("region", "country", "state", "province", "city", "postal", "zip"),
    "commerce": ("department", "category", "subcategory", "brand", "product", "sku"),
    "organization": ("company", "division", "department", "team", "manager", "employee"),
}
# Fields a user may override, with their types.
OVERRIDABLE = {
    "semantic_role": "string",
    "subtype": "string",
    "metric_family": "string",
    "default_aggregation": "string",
    "is_additive": "boolean",
    "format_hint": "string",
    "time_grain": "string",
    "analysis_priority": "int",
    "certified": "boolean",
    "business_name": "string",
    "description": "string",
}
# Upper bounds in days of the time grains, in order: below the first two, up to the others.
GRAINS_BELOW = ((1 / 24, "sub-hourly"), (1, "hourly"))
GRAINS_UP_TO = ((2, "daily"), (8, "weekly"), (32, "monthly"), (100, "quarterly"))
CALENDAR_LEVELS = ("year", "quarter", "month", "week", "day")
GRAIN_UNIQUENESS, GRAIN_NULLS, TEXT_GRAIN_NULLS = 0.9, 0.2, 0.1
FACT_ROWS, RECOMMENDED = 25, 4


def has_hint(name: Column, hints: tuple[str, ...]) -> Column:
    return reduce(or_, (name.contains(h) for h in hints))


def named_as_date(name: str) -> bool:
    return any(h in name.lower() for h in DATE)


def cardinality_band(unique: Column, rows: Column) -> Column:
    """M2."""
    ratio = unique / F.greatest(rows, F.lit(1))
    return (
        F.when(unique <= 1, "constant")
        .when(unique <= 12, "low")
        .when((unique <= 50) | (ratio <= 0.15), "medium")
        .when(ratio >= 0.85, "very_high")
        .otherwise("high")
    )


def metric_family(name: Column, kind: Column) -> Column:
    """M5: by name, percentage first."""
    return (
        F.when(has_hint(name, PERCENT), "percentage")
        .when(has_hint(name, CURRENCY), "currency")
        .when(has_hint(name, COUNT), "count")
        .when((kind == "boolean") | has_hint(name, BOOLEAN), "boolean")
        .otherwise("numeric")
    )


def hierarchy_hint(name: Column) -> Column:
    """M6: the first template level found in the name, with the levels below it."""
    hint = F.lit(None).cast("struct<name:string,level:string,next_levels:array<string>>")
    steps = [(h, i, level) for h, levels in HIERARCHIES.items() for i, level in enumerate(levels)]
    for h, i, level in reversed(steps):
        following = [F.lit(x) for x in HIERARCHIES[h][i + 1 :]]
        found = F.struct(
            F.lit(h).alias("name"),
            F.lit(level).alias("level"),
            (F.array(*following) if following else F.array().cast("array<string>")).alias("next_levels"),
        )
        hint = F.when(name.contains(level), found).otherwise(hint)
    return hint


def median_gap_days(df: DataFrame, column: str) -> float | None:
    """The median gap between ordered timestamps in days; one number, read ahead of the plan.

    The gap counts feed a size check and the selection, so they are kept until both are done.
    """
    gaps = gap_counts(df.select(moment(df, column).alias("t")), "t").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        median = quantiles(gaps, {"gap": F.col("gap_seconds")}, [0.5], weight=F.col("freq")).first()["gap"]
    finally:
        gaps.unpersist()
    return median[0] / 86_400 if median else None


def grain_of_days(days: float | None) -> str:
    if days is None:
        return "unknown"
    for bound, label in GRAINS_BELOW:
        if days < bound:
            return label
    return next((label for bound, label in GRAINS_UP_TO if days <= bound), "yearly")


def time_grain(df: DataFrame, column: str) -> DataFrame:
    """M4: (name, median_gap_days, time_grain) of a date column."""
    days = median_gap_days(df, column)
    row = (column, days, grain_of_days(days))
    return df.sparkSession.createDataFrame([row], "name string, median_gap_days double, time_grain string")


def column_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: position, kind, row and value counts, distinct values, sequence test (M3).

    One scan for the counts and bounds, one shuffle of distinct values (none if ``approximate``).
    A whole-number column is a sequence when its distinct values fill their range exactly.
    """
    numeric = [c for c in df.columns if is_profiled_as_number(df.schema[c].dataType)]
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(present(df, c)).alias(f"n{i}"))
        if approximate:
            aggs.append(F.approx_count_distinct(present(df, c), 0.02).alias(f"u{i}"))
        if c in numeric:
            v = number(df, c)
            aggs += [
                F.min(v).alias(f"lo{i}"),
                F.max(v).alias(f"hi{i}"),
                F.count_if(v != F.floor(v)).alias(f"frac{i}"),
            ]
    null = F.lit(None).cast("double")
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("name"),
            F.lit(kind_of(df.schema[c].dataType)).alias("kind"),
            F.col("rows"),
            F.col(f"n{i}").alias("non_null_count"),
            (F.col(f"lo{i}") if c in numeric else null).alias("lo"),
            (F.col(f"hi{i}") if c in numeric else null).alias("hi"),
            (F.col(f"frac{i}") == 0 if c in numeric else F.lit(False)).alias("whole"),
            (F.col(f"u{i}") if approximate else F.lit(None).cast("long")).alias("sketch_unique"),
        )
        for i, c in enumerate(df.columns)
    ]
    stats = df.agg(*aggs).select(F.inline(F.array(*entries)))
    if approximate:
        stats = stats.withColumn("unique_count", F.col("sketch_unique"))
    else:
        counted = distinct_values(df, df.columns).withColumnRenamed("column", "name")
        stats = stats.join(counted, "name", "left").withColumn("unique_count", F.coalesce("unique", F.lit(0)).cast("long"))
    fills_range = F.col("hi") - F.col("lo") + 1 == F.col("unique_count")
    return stats.select(
        "position",
        "name",
        "kind",
        "rows",
        "non_null_count",
        "unique_count",
        F.coalesce(F.col("whole") & (F.col("unique_count") >= 3) & fills_range, F.lit(False)).alias("is_sequence"),
    )


def classify(stats: DataFrame, grains: Mapping[str, str] | None = None) -> DataFrame:
    """M1: roles and everything derived from them, over one row per column.

    ``grains`` names the time grain of every date column.
    """
    name = F.lower("name")
    kind, rows, unique = F.col("kind"), F.greatest("rows", F.lit(1)), F.col("unique_count")
    uniqueness = unique / F.greatest("non_null_count", F.lit(1))
    id_named = (has_hint(name, IDENTIFIER) & (uniqueness > 0.9)) | name.endswith("_id")
    is_date = (kind == "datetime") | has_hint(name, DATE)
    is_number = kind.isin("numeric", "boolean")
    is_flag = has_hint(name, BOOLEAN)
    free_text = has_hint(name, TEXT) & (unique > F.greatest(F.lit(20), F.floor(rows * 0.3)))

    role = (
        F.when(is_date, "datetime")
        .when(is_number, F.when(id_named | F.col("is_sequence"), "identifier").otherwise("measure"))
        .when(~is_flag & id_named, "identifier")
        .otherwise("dimension")
    )
    family = (
        F.when(is_date, "categorical")
        .when(is_number, F.when(role == "identifier", "identifier").otherwise(metric_family(name, kind)))
        .otherwise("categorical")
    )
    text_subtype = (
        F.when(is_flag, "boolean")
        .when(id_named, "identifier")
        .when(has_hint(name, GEOGRAPHY), "geography")
        .when(free_text, "text")
        .otherwise("category")
    )
    table = stats.select(
        "*",
        role.alias("semantic_role"),
        F.when(is_date, "date").when(is_number, family).otherwise(text_subtype).alias("subtype"),
        family.alias("metric_family"),
        nearest(uniqueness, 4).alias("uniqueness_ratio"),
        nearest(1 - F.col("non_null_count") / rows, 4).alias("null_ratio"),
        cardinality_band(unique, rows).alias("cardinality_band"),
        hierarchy_hint(name).alias("hierarchy"),
    )
    r, f, band = F.col("semantic_role"), F.col("metric_family"), F.col("cardinality_band")
    grain = F.lit(None).cast("string")
    for column, label in (grains or {}).items():
        grain = F.when(F.col("name") == column, label).otherwise(grain)
    table = table.withColumn("time_grain", grain)
    priority = (
        F.when(
            r == "measure",
            F.when(f == "currency", 95).when(f == "percentage", 82).when(unique > 1, 90).otherwise(40),
        )
        .when(r == "datetime", 88)
        .when(r == "dimension", F.when(band.isin("low", "medium"), 80).otherwise(58))
        .when(r == "identifier", 42)
        .otherwise(50)
    )
    aggregation = (
        F.when(r == "datetime", "none")
        .when(r == "identifier", "count_distinct")
        .when(r == "measure", F.when(f.isin("percentage", "boolean"), "average").otherwise("sum"))
        .otherwise("count")
    )
    format_hint = (
        F.when(F.col("subtype") == "date", "date")
        .when(f == "currency", "currency")
        .when(f == "percentage", "percentage")
        .when(f == "count", "integer")
        .otherwise("number")
    )
    reasons = F.array_compact(
        F.array(
            F.when(r == "datetime", F.lit("Typed or named as a date.")),
            F.when(F.col("time_grain") != "unknown", F.concat(F.lit("Typical spacing is "), "time_grain", F.lit("."))),
            F.when(r == "measure", F.concat(F.lit("Numeric measure of the "), f, F.lit(" family."))),
            F.when(r == "identifier", F.lit("Name and distinct values point to an identifier.")),
            F.when(r == "dimension", F.concat(F.lit("Grouping field of type "), "subtype", F.lit("."))),
            F.when((r == "dimension") & (band == "low"), F.lit("Few distinct values: fits grouping and filters.")),
            F.when(
                (r == "dimension") & band.isin("high", "very_high"),
                F.lit("Many distinct values: rank or search instead of charting all."),
            ),
            F.when(
                F.col("hierarchy").isNotNull(),
                F.concat(F.lit("Level "), "hierarchy.level", F.lit(" of the "), "hierarchy.name", F.lit(" hierarchy.")),
            ),
        )
    )
    return table.select(
        "position",
        "name",
        "semantic_role",
        "subtype",
        "metric_family",
        "unique_count",
        "uniqueness_ratio",
        "null_ratio",
        "non_null_count",
        aggregation.alias("default_aggregation"),
        ((r == "measure") & f.isin("currency", "count", "numeric")).alias("is_additive"),
        format_hint.alias("format_hint"),
        "cardinality_band",
        priority.alias("analysis_priority"),
        "time_grain",
        "hierarchy",
        reasons.alias("rationale"),
        F.lit(False).alias("certified"),
        F.col("name").alias("business_name"),
        F.lit("").alias("description"),
        F.lit("inferred").alias("override_source"),
    )


_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType()}


def apply_overrides(profiles: DataFrame, overrides: Mapping[str, Mapping] | None) -> DataFrame:
    """M7: manual values win over inferred ones; unknown fields and empty values are ignored."""
    rows = []
    for column, chosen in (overrides or {}).items():
        if isinstance(chosen, Mapping):
            rows.append((column, *[None if chosen.get(f) == "" else chosen.get(f) for f in OVERRIDABLE]))
    if not rows:
        return profiles
    schema = T.StructType([T.StructField("name", T.StringType())])
    for f, dtype in OVERRIDABLE.items():
        schema = schema.add(f"o_{f}", _TYPES[dtype])
    manual = profiles.sparkSession.createDataFrame(rows, schema).withColumn("o_manual", F.lit(True))
    joined = profiles.join(F.broadcast(manual), "name", "left")
    is_manual = F.col("o_manual").isNotNull()
    out = []
    for c in profiles.columns:
        if c in OVERRIDABLE:
            out.append(F.coalesce(f"o_{c}", c).alias(c))
        elif c == "override_source":
            out.append(F.when(is_manual, "manual").otherwise(F.col(c)).alias(c))
        elif c == "rationale":
            note = F.array(F.lit("Adjusted by hand; this is the agreed definition."))
            out.append(F.when(is_manual, F.concat(c, note)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def infer_semantics(
    df: DataFrame,
    overrides: Mapping[str, Mapping] | None = None,
    approximate: bool = False,
    with_grain: bool = True,
) -> DataFrame:
    """M8: the semantic profile of every column, manual overrides applied."""
    grains = None
    if with_grain:
        dated = [c for c in df.columns if kind_of(df.schema[c].dataType) == "datetime" or named_as_date(c)]
        grains = {c: grain_of_days(median_gap_days(df, c)) for c in dated}
    return apply_overrides(classify(column_stats(df, approximate), grains), overrides)


def dataset_model(profiles: DataFrame, row_count: int | Column) -> DataFrame:
    """M9: role, grain, dates, recommendations, coverage and warnings of a dataset; one row.

    The profile has one row per column, so its ordered lists are bounded by the schema.
    """
    rows = F.lit(row_count) if isinstance(row_count, int) else row_count
    r = F.col("semantic_role")

    def listed(condition: Column, *order: Column) -> Column:
        """Names where ``condition`` holds, sorted by ``order`` and position."""
        entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "position", "name")
        return F.transform(F.array_sort(F.collect_list(F.when(condition, entry))), lambda e: e["name"])

    by_priority = -F.col("analysis_priority")
    summary = profiles.agg(
        F.count_if(r == "measure").alias("measures"),
        F.count_if(r == "dimension").alias("dimensions"),
        F.count_if(r == "datetime").alias("datetimes"),
        F.count_if(r == "identifier").alias("identifiers"),
        listed(
            (r == "identifier") & (F.col("uniqueness_ratio") >= GRAIN_UNIQUENESS) & (F.col("null_ratio") <= GRAIN_NULLS)
        ).alias("id_grain"),
        F.slice(
            listed(
                (r == "dimension")
                & (F.col("cardinality_band") == "very_high")
                & (F.col("null_ratio") <= TEXT_GRAIN_NULLS)
            ),
            1,
            2,
        ).alias("text_grain"),
        listed(r == "datetime").alias("date_columns"),
        F.slice(listed(r == "measure", by_priority), 1, RECOMMENDED).alias("recommended_measures"),
        F.slice(
            listed((r == "dimension") & F.col("cardinality_band").isin("low", "medium"), by_priority), 1, RECOMMENDED
        ).alias("recommended_dimensions"),
        listed((r == "measure") & F.col("certified")).alias("certified_metrics"),
        F.count_if(F.col("override_source") == "manual").alias("manual_override_count"),
        F.transform(
            F.array_sort(F.collect_list(F.when(r == "datetime", F.struct("position", "name", "time_grain")))),
            lambda e: F.struct(
                e["name"].alias("column"),
                F.coalesce(e["time_grain"], F.lit("unknown")).alias("grain"),
                F.array(*[F.lit(x) for x in CALENDAR_LEVELS]).alias("levels"),
            ),
        ).alias("date_hierarchies"),
    )
    measures, dimensions, identifiers = F.col("measures"), F.col("dimensions"), F.col("identifiers")
    grain = F.when(F.size("id_grain") > 0, F.col("id_grain")).otherwise(F.col("text_grain"))
    return summary.select(
        F.when((measures > 0) & ((rows >= FACT_ROWS) | (measures >= 2)), "fact")
        .when((measures > 0) & (dimensions > 0), "hybrid")
        .when((identifiers > 0) & (dimensions > 0), "lookup")
        .otherwise("dimension")
        .alias("dataset_role"),
        F.when(F.size(grain) > 0, F.array_join(grain, " + ")).otherwise("unspecified").alias("row_grain"),
        grain.alias("grain_candidates"),
        F.when(F.size("date_columns") > 0, F.col("date_columns")[0]).alias("primary_date_column"),
        "date_hierarchies",
        "recommended_measures",
        "recommended_dimensions",
        "measures",
        "dimensions",
        "datetimes",
        "identifiers",
        F.array_compact(
            F.array(
                F.when(measures == 0, F.lit("No measures found; expect profiling rather than KPI work.")),
                F.when(dimensions == 0, F.lit("No grouping dimensions found; comparisons are limited.")),
                F.when(F.col("datetimes") > 1, F.lit("Several date fields found; pick a primary time axis.")),
                F.when(F.size(grain) == 0, F.lit("The row grain is unclear; check identifiers before joining.")),
            )
        ).alias("warnings"),
        "certified_metrics",
        "manual_override_count",
    )
