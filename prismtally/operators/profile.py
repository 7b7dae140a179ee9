"""Overview, column profiles, quality alerts and filter options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import (
    as_text,
    categorical_columns,
    col,
    datetime_columns,
    is_profiled_as_number,
    kind_of,
    local_frame,
    moment,
    number,
    numeric_columns,
    present,
    ratio_pct,
)
from prismtally.functions.distinct import distinct_values
from prismtally.functions.frequencies import (
    DIGEST_OVER,
    digest,
    digests,
    long_form,
    may_be_long,
    top_values,
    value_counts,
)
from prismtally.functions.moments import column_moments
from prismtally.functions.quantiles import quantile_row
from prismtally.functions.stats import sample_kurtosis, sample_skewness

# Fixed values of the quality checks and fences.
FENCE = 1.5
MISSING_ALERT, OUTLIER_ALERT, MAX_ALERTS = 30, 10, 8
FILTER_VALUES, FILTER_DISTINCT = 15, 20


def row_copies(df: DataFrame) -> DataFrame:
    """(rows, duplicates, filled cells) from one aggregate over equal rows.

    The shuffle key is the whole row (long texts as digests), and copies collapse before it is sent.
    """
    keyed = df.select(*[
        (digest(as_text(df, c)) if may_be_long(df.schema[c].dataType) else present(df, c)).alias(f"k{i}")
        for i, c in enumerate(df.columns)
    ])
    copies = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    filled = sum((F.col(k).isNotNull().cast("int") for k in keyed.columns), F.lit(0))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.col("n") * filled), F.lit(0)).alias("filled"),
    )


def overview(df: DataFrame) -> DataFrame:
    """A1: one row of counts, completeness and duplicates; a single pass over the data."""
    width = len(df.columns)
    cells = F.greatest(F.col("rows") * width, F.lit(1))
    return row_copies(df).select(
        F.col("rows").cast("long").alias("rows"),
        F.lit(width).cast("long").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("long").alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).cast("long").alias("datetime_columns"),
        F.round(100 - ratio_pct(F.col("rows") * width - F.col("filled"), cells), 2).alias("completeness_pct"),
        F.col("duplicates").cast("long").alias("duplicate_rows"),
        ratio_pct(F.col("duplicates"), F.col("rows")).alias("duplicate_pct"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Name, type and missing count per column; one scan, no shuffle beyond the final row."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    entries = [
        F.struct(
            F.lit(c).alias("name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col(f"c{i}").alias("non_null_count"),
            (F.col("rows") - F.col(f"c{i}")).alias("missing_count"),
            F.col("rows").alias("rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def column_info(df: DataFrame, approximate: bool = False) -> DataFrame:
    """A2 / A10: non-null, missing and distinct counts per column."""
    if approximate:
        wide = df.agg(
            *[F.approx_count_distinct(present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
        )
        unique = wide.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("unique")) for i, c in enumerate(df.columns)]))
        )
    else:
        unique = distinct_values(df, df.columns)
    return (
        missing_summary(df)
        .join(unique, F.col("name") == F.col("column"), "left")
        .select(
            "name",
            "dtype",
            "non_null_count",
            "missing_count",
            ratio_pct(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
            F.coalesce("unique", F.lit(0)).cast("long").alias("unique_count"),
        )
    )


def sample_values(df: DataFrame, k: int = 3) -> DataFrame:
    """A2: ``k`` example values per column; the smallest as text, so the answer is stable.

    Each of ``k`` scans takes the next larger value of every column, so a task sends one value per column and no text is shuffled.
    """
    found: dict[str, list[str]] = {c: [] for c in df.columns}
    for place in range(k):
        going = [c for c in df.columns if len(found[c]) == place]
        if not going:
            break
        texts = {c: as_text(df, c) for c in going}
        larger = [F.min(F.when(texts[c] > F.lit(found[c][-1]), texts[c]) if place else texts[c]).alias(f"m{i}") for i, c in enumerate(going)]
        row = df.agg(*larger).first()
        for i, c in enumerate(going):
            if row[f"m{i}"] is not None:
                found[c].append(row[f"m{i}"])
    return df.sparkSession.createDataFrame([(c, v) for c, v in found.items() if v], "name string, samples array<string>")


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_profiled_as_number(f.dataType)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """A3 / A4: moments, quartiles and the share outside the 1.5 IQR fences per numeric column.

    Three scans, whatever the columns: two for exact quartiles, one for everything else.
    """
    columns = columns if columns is not None else number_columns(df)
    schema = (
        "name string, mean double, median double, std double, min double, max double, q1 double, q3 double, "
        "skewness double, kurtosis double, outlier_pct double"
    )
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    quartiles = quantile_row(df, {c: number(df, c) for c in columns}, [0.25, 0.5, 0.75])
    fences = []
    for c in columns:
        q1, _, q3 = quartiles[c] or (0.0, 0.0, 0.0)
        fences.append((q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)) if q3 > q1 else None)
    fields = column_moments(df, [number(df, c) for c in columns], fences)
    rows = [(c, *(quartiles[c] or (None,) * 3), *map(float, fields[:, i])) for i, c in enumerate(columns)]
    raw = local_frame(df.sparkSession, rows, "name string, q1 double, median double, q3 double, n double, mean double, m2 double, m3 double, m4 double, low double, high double, outside double, total double")
    some, n = F.col("n") > 0, F.col("n")
    skew = F.try_divide(F.sqrt(n) * F.col("m3"), F.pow("m2", F.lit(1.5)))
    kurtosis = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2")) - 3
    return raw.select(
        "name",
        F.round(F.when(some, F.col("total") / n), digits).alias("mean"),
        F.round("median", digits).alias("median"),
        F.round(F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))), digits).alias("std"),
        F.round(F.when(some, F.col("low")), digits).alias("min"),
        F.round(F.when(some, F.col("high")), digits).alias("max"),
        F.round("q1", digits).alias("q1"),
        F.round("q3", digits).alias("q3"),
        F.round(sample_skewness(skew, n), digits).alias("skewness"),
        F.round(sample_kurtosis(kurtosis, n), digits).alias("kurtosis"),
        ratio_pct(F.col("outside"), n).alias("outlier_pct"),
    )


def datetime_profile(df: DataFrame) -> DataFrame:
    """A5: earliest and latest value per datetime column."""
    columns = datetime_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "name string, min timestamp_ntz, max timestamp_ntz")
    wide = df.agg(*[f(moment(df, c)).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.min, F.max)])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("name"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


def categorical_profile(df: DataFrame, columns: list[str] | None = None, k: int = 3) -> DataFrame:
    """The top values of every categorical column with count and share."""
    if columns is None:
        columns = [c for c in categorical_columns(df) if not is_profiled_as_number(df.schema[c].dataType)]
    long_texts = _long_texts(df, columns)
    counts = value_counts(df, texts=digests(df, columns)) if long_texts else value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("non_null"))
    top = top_values(counts, k)
    if long_texts:
        top = _with_texts(df, columns, top)
    return top.join(totals, "column").select(
        F.col("column").alias("name"),
        F.col("rank").cast("long").alias("rank"),
        F.col("value").alias("label"),
        F.col("n").alias("count"),
        ratio_pct(F.col("n"), F.col("non_null")).alias("pct"),
    )


def _long_texts(df: DataFrame, columns: list[str]) -> bool:
    """Whether any of the columns holds texts too long to be shuffled for counting (one scan)."""
    long_ = [c for c in columns if may_be_long(df.schema[c].dataType)]
    row = df.agg(*[F.max(F.length(as_text(df, c))) for c in long_]).first() if long_ else ()
    return any(n is not None and n > DIGEST_OVER for n in row)


def _with_texts(df: DataFrame, columns: list[str], top: DataFrame) -> DataFrame:
    """Put the texts back for top values that were counted by digest.

    They are a handful per column, so they are broadcast to a second scan that reads their texts.
    """
    wanted = top.select("column", F.col("value").alias("digest"))
    texts = long_form(df, {c: as_text(df, c) for c in columns}).withColumn("digest", digest(F.col("value")))
    named = texts.join(F.broadcast(wanted), ["column", "digest"]).groupBy("column", "digest").agg(
        F.min("value").alias("value")
    )
    return top.withColumnRenamed("value", "digest").join(named, ["column", "digest"])


def quality_alerts(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Duplicates, heavy missingness and outliers in column order, or one all-clear row; at most 8.

    ``facts`` is an :func:`overview` computed before, if there is one.
    """
    spark = df.sparkSession
    text_of = _plain_number
    copies = (overview(df) if facts is None else facts).where(F.col("duplicate_rows") > 0).select(
        F.lit(-1).alias("position"),
        F.lit(0).alias("step"),
        F.lit("warning").alias("severity"),
        F.lit("Repeated rows").alias("title"),
        F.concat(
            F.col("duplicate_rows").cast("string"), F.lit(" rows ("), text_of("duplicate_pct"),
            F.lit("%) repeat another row in full."),
        ).alias("detail"),
    )
    places = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "name string, position int")
    missing = (
        missing_summary(df)
        .withColumn("missing_pct", ratio_pct(F.col("missing_count"), F.col("rows")))
        .where(F.col("missing_pct") >= MISSING_ALERT)
        .join(F.broadcast(places), "name")
        .select(
            "position",
            F.lit(1).alias("step"),
            F.lit("warning").alias("severity"),
            F.concat(F.lit("Many gaps in '"), "name", F.lit("'")).alias("title"),
            F.concat(
                text_of("missing_pct"),
                F.lit("% of its cells are missing."),
            ).alias("detail"),
        )
    )
    outliers = (
        numeric_profile(df)
        .where(F.col("outlier_pct") >= OUTLIER_ALERT)
        .join(F.broadcast(places), "name")
        .select(
            "position",
            F.lit(2).alias("step"),
            F.lit("info").alias("severity"),
            F.concat(F.lit("Far values in '"), "name", F.lit("'")).alias("title"),
            F.concat(
                text_of("outlier_pct"),
                F.lit("% of its values lie beyond the fences; prefer the median."),
            ).alias("detail"),
        )
    )
    clear = spark.range(1).select(
        F.lit(1 << 30).alias("position"),
        F.lit(3).alias("step"),
        F.lit("success").alias("severity"),
        F.lit("No quality alert").alias("title"),
        F.lit("Repeats, gaps and far values are all below their limits.").alias("detail"),
    )
    # A handful of rows per column: ranking them in one window is bounded by the schema.
    found = copies.unionByName(missing).unionByName(outliers).unionByName(clear)
    ranked = found.withColumn(
        "alert", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position", "step"))
    )
    return ranked.where((F.col("alert") <= MAX_ALERTS) & ((F.col("severity") != "success") | (F.col("alert") == 1))).select(
        F.col("alert").cast("long").alias("alert"), "severity", "title", "detail"
    )


def _plain_number(name: str):
    """A rounded double as plain text: no exponent, at least one decimal."""
    fixed = F.regexp_replace(F.format_string("%.2f", F.col(name)), "0+$", "")
    return F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def filter_options(df: DataFrame, semantics: DataFrame) -> DataFrame:
    """The values offered per dimension, most frequent first, and the date columns.

    ``semantics`` is the column profile of :mod:`prismtally.operators.semantics`. Dimensions
    with few distinct values or a geographic meaning qualify.
    """
    profile = semantics.select("name", "semantic_role", "subtype", "unique_count").collect()
    order = {c: i for i, c in enumerate(df.columns)}
    chosen = sorted(
        (
            r["name"]
            for r in profile
            if r["semantic_role"] == "dimension" and (r["unique_count"] <= FILTER_DISTINCT or r["subtype"] == "geography")
        ),
        key=order.get,
    )
    values = top_values(value_counts(df, chosen), FILTER_VALUES).select(
        F.col("column").alias("name"), F.lit("dimension").alias("role"), F.col("rank").cast("long").alias("rank"), "value"
    )
    dates = df.sparkSession.createDataFrame(
        [(r["name"], "date", None, None) for r in profile if r["semantic_role"] == "datetime"],
        "name string, role string, rank long, value string",
    )
    return values.unionByName(dates)


def preview(df: DataFrame, k: int = 5) -> DataFrame:
    """The first rows with display values: 4 decimals, formatted dates, JSON for nested values."""
    out = []
    for f in df.schema.fields:
        kind = kind_of(f.dataType)
        if kind == "numeric" and f.dataType.typeName() in ("double", "float"):
            v = number(df, f.name)
            out.append(F.round(F.when(F.abs(v) < float("inf"), v), 4).alias(f.name))
        elif kind in ("numeric", "boolean"):
            out.append(col(f.name))
        elif kind == "datetime":
            out.append(F.date_format(moment(df, f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(as_text(df, f.name).alias(f.name))
    return df.limit(k).select(*out)
