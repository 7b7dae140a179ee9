"""Profiles, quality and the semantic model."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.operators import profile, semantics
from prismtally.queries.registry import query, table

TABLES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _gappy(spark, sf):
    """Events with copies, gaps and few distinct values."""
    return table(spark, sf, "events").select(
        "event_type",
        F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") / 20)).alias("level"),
        F.when(F.col("event_id") % 2 != 0, F.col("user_id") % 5).alias("bucket"),
    )


_GAPPY = """(SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value / 20) AS BIGINT) END AS level,
                    CASE WHEN event_id % 2 <> 0 THEN user_id % 5 END AS bucket FROM events)"""


@query(
    "A1_overview_gaps",
    f"""WITH e AS {_GAPPY}, d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM e)),
             s AS (SELECT count(*) AS n, count(event_type) + count(level) + count(bucket) AS filled FROM e)
        SELECT CAST(n AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS numeric_columns,
               CAST(1 AS BIGINT) AS categorical_columns, CAST(0 AS BIGINT) AS datetime_columns,
               round(100 - CAST(printf('%.2f', CAST((n * 3 - filled) / (n * 3) * 100 AS DOUBLE)) AS DOUBLE), 2) AS completeness_pct,
               CAST(n - k AS BIGINT) AS duplicate_rows, CAST(printf('%.2f', CAST((n - k) / n * 100 AS DOUBLE)) AS DOUBLE) AS duplicate_pct FROM s, d""",
)
def a1_gaps(spark, sf):
    return profile.overview(_gappy(spark, sf))


def _overview_sql(name: str, numeric: int, categorical: int, dates: int) -> str:
    columns = TABLES[name]
    filled = " + ".join(f"count({c})" for c in columns)
    return f"""
      WITH d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {name})),
           s AS (SELECT count(*) AS n, {filled} AS filled FROM {name})
      SELECT CAST(n AS BIGINT) AS rows, CAST({len(columns)} AS BIGINT) AS columns,
             CAST({numeric} AS BIGINT) AS numeric_columns, CAST({categorical} AS BIGINT) AS categorical_columns,
             CAST({dates} AS BIGINT) AS datetime_columns,
             round(100 - CAST(printf('%.2f', CAST((n * {len(columns)} - filled) / (n * {len(columns)}) * 100 AS DOUBLE)) AS DOUBLE), 2) AS completeness_pct,
             CAST(n - k AS BIGINT) AS duplicate_rows, CAST(printf('%.2f', CAST((n - k) / n * 100 AS DOUBLE)) AS DOUBLE) AS duplicate_pct FROM s, d"""


@query("A1_overview_lineitem", _overview_sql("lineitem", 8, 2, 1))
def a1_lineitem(spark, sf):
    return profile.overview(table(spark, sf, "lineitem"))


@query("A1_overview_documents", _overview_sql("documents", 2, 3, 0))
def a1_documents(spark, sf):
    return profile.overview(table(spark, sf, "documents"))


def _info_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null_count, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
        f"CAST(printf('%.2f', CAST((count(*) - count({c})) / count(*) * 100 AS DOUBLE)) AS DOUBLE) AS missing_pct, "
        f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM {source}"
        for c, t in columns
    )


@query("A2_column_info_gaps", f"WITH e AS {_GAPPY} " + _info_sql("e", [("event_type", "string"), ("level", "bigint"), ("bucket", "bigint")]))
def a2_gaps(spark, sf):
    return profile.column_info(_gappy(spark, sf))


@query(
    "A2_column_info_documents",
    _info_sql("documents", [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]),
)
def a2_documents(spark, sf):
    return profile.column_info(table(spark, sf, "documents"))


@query(
    "A2_sample_values",
    """SELECT name, string_agg(v, ' | ' ORDER BY v) AS samples FROM (
         SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) AS k FROM (
           SELECT DISTINCT 'o_orderstatus' AS name, o_orderstatus AS v FROM orders
           UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
           UNION ALL SELECT DISTINCT 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders
           UNION ALL SELECT DISTINCT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
           UNION ALL SELECT DISTINCT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders
           UNION ALL SELECT DISTINCT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders))
       WHERE k <= 3 GROUP BY name""",
)
def a2_samples(spark, sf):
    found = profile.sample_values(table(spark, sf, "orders"))
    return found.withColumn("samples", F.array_join("samples", " | "))


def _numeric_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
                round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
                round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
                round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
                CAST(printf('%.2f', (SELECT count(*) FROM {source} AS s,
                         (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source}) AS q
                       WHERE q.b > q.a AND (s.{c} < q.a - 1.5 * (q.b - q.a) OR s.{c} > q.b + 1.5 * (q.b - q.a)))
                      / count({c}) * 100) AS DOUBLE) AS outlier_pct FROM {source}"""
        )
    return " UNION ALL ".join(parts)


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A3_numeric_profile", _numeric_sql("lineitem", _NUMBERS))
def a3(spark, sf):
    return profile.numeric_profile(table(spark, sf, "lineitem"))


@query(
    "A3_numeric_profile_events",
    f"WITH e AS (SELECT value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * value END AS squared FROM events) {_numeric_sql('e', ['value', 'squared'])}",
)
def a3_events(spark, sf):
    rows = table(spark, sf, "events").select(
        "value", F.when(F.col("event_id") % 3 != 0, F.col("value") * F.col("value")).alias("squared")
    )
    return profile.numeric_profile(rows)


@query(
    "A4_shape",
    """SELECT 'c_acctbal' AS name, round(skewness(c_acctbal), 4) AS skewness, round(kurtosis(c_acctbal), 4) AS kurtosis FROM customer""",
)
def a4(spark, sf):
    return profile.numeric_profile(table(spark, sf, "customer"), ["c_acctbal"]).select("name", "skewness", "kurtosis")


@query(
    "A5_datetime_profile",
    "SELECT 'o_orderdate' AS name, min(o_orderdate) AS min, max(o_orderdate) AS max FROM orders",
)
def a5(spark, sf):
    return profile.datetime_profile(table(spark, sf, "orders"))


@query(
    "A6_top_values",
    """WITH c AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL
                  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY name) AS t FROM c)
       SELECT name, CAST(k AS BIGINT) AS rank, label, CAST(n AS BIGINT) AS count, CAST(printf('%.2f', CAST(n / t * 100 AS DOUBLE)) AS DOUBLE) AS pct FROM r WHERE k <= 3""",
)
def a6(spark, sf):
    return profile.categorical_profile(table(spark, sf, "orders"))


@query(
    "A6_top_values_long_texts",
    """WITH c AS (SELECT 'lang' AS name, lang AS label, lang AS tie, count(*) AS n FROM documents GROUP BY ALL
                  UNION ALL SELECT 'source', source, source, count(*) FROM documents GROUP BY ALL
                  UNION ALL SELECT 'text', text, CASE WHEN length(text) > 64 THEN sha256(text) ELSE text END, count(*) FROM documents GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, tie) AS k, sum(n) OVER (PARTITION BY name) AS t FROM c)
       SELECT name, CAST(k AS BIGINT) AS rank, label, CAST(n AS BIGINT) AS count, CAST(printf('%.2f', CAST(n / t * 100 AS DOUBLE)) AS DOUBLE) AS pct FROM r WHERE k <= 3""",
)
def a6_long(spark, sf):
    return profile.categorical_profile(table(spark, sf, "documents"), ["text", "lang", "source"])


@query(
    "A7_quality_alerts",
    f"""WITH e AS (SELECT event_type, level, bucket, CASE WHEN bucket = 1 THEN 100.0 ELSE bucket * 0.01 END AS spike FROM {_GAPPY}),
        n AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS k,
                     count(level) AS l, count(bucket) AS b FROM e),
        q AS (SELECT quantile_cont(spike, 0.25) AS lo, quantile_cont(spike, 0.75) AS hi, count(spike) AS c FROM e),
        o AS (SELECT CAST(printf('%.2f', CAST((SELECT count(*) FROM e, q WHERE spike < lo - 1.5 * (hi - lo) OR spike > hi + 1.5 * (hi - lo)) / c * 100 AS DOUBLE)) AS DOUBLE) AS pct FROM q),
        a AS (SELECT 1 AS p, 'warning' AS severity, 'Repeated rows' AS title,
                     (n - k) || ' rows (' || CAST(CAST(printf('%.2f', CAST((n - k) / n * 100 AS DOUBLE)) AS DOUBLE) AS VARCHAR) || '%) repeat another row in full.' AS detail FROM n
              UNION ALL SELECT 2, 'warning', 'Many gaps in ''level''', CAST(CAST(printf('%.2f', CAST((n - l) / n * 100 AS DOUBLE)) AS DOUBLE) AS VARCHAR) || '% of its cells are missing.' FROM n WHERE round((n - l) * 100.0 / n, 2) >= 30
              UNION ALL SELECT 3, 'warning', 'Many gaps in ''bucket''', CAST(CAST(printf('%.2f', CAST((n - b) / n * 100 AS DOUBLE)) AS DOUBLE) AS VARCHAR) || '% of its cells are missing.' FROM n WHERE round((n - b) * 100.0 / n, 2) >= 30
              UNION ALL SELECT 4, 'warning', 'Many gaps in ''spike''', CAST(CAST(printf('%.2f', CAST((n - b) / n * 100 AS DOUBLE)) AS DOUBLE) AS VARCHAR) || '% of its cells are missing.' FROM n WHERE round((n - b) * 100.0 / n, 2) >= 30
              UNION ALL SELECT 5, 'info', 'Far values in ''spike''', CAST(CAST(pct AS DOUBLE) AS VARCHAR) || '% of its values lie beyond the fences; prefer the median.' FROM o WHERE pct >= 10)
        SELECT CAST(row_number() OVER (ORDER BY p) AS BIGINT) AS alert, severity, title, detail FROM a""",
)
def a7(spark, sf):
    rows = _gappy(spark, sf).withColumn("spike", F.when(F.col("bucket") == 1, 100.0).otherwise(F.col("bucket") * 0.01))
    return profile.quality_alerts(rows)


@query(
    "A8_safe_ratio",
    """SELECT o_orderstatus, CAST(printf('%.2f', CAST(coalesce(count(*) FILTER (o_totalprice > 200000) / nullif(count(*), 0) * 100, 0) AS DOUBLE)) AS DOUBLE) AS pct,
              CAST(0 AS DOUBLE) AS pct_of_nothing FROM orders GROUP BY 1""",
)
def a8(spark, sf):
    rich = F.count_if(F.col("o_totalprice") > 200000)
    grouped = table(spark, sf, "orders").groupBy("o_orderstatus").agg(rich.alias("k"), F.count(F.lit(1)).alias("n"))
    return grouped.select(
        "o_orderstatus",
        profile.ratio_pct(F.col("k"), F.col("n")).alias("pct"),
        profile.ratio_pct(F.col("k"), F.lit(0)).alias("pct_of_nothing"),
    )


@query(
    "A9_missing_summary",
    f"WITH e AS {_GAPPY} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null_count, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS missing_count, CAST(count(*) AS BIGINT) AS rows FROM e"
        for c, t in (("event_type", "string"), ("level", "bigint"), ("bucket", "bigint"))
    ),
)
def a9(spark, sf):
    return profile.missing_summary(_gappy(spark, sf))


@query(
    "A10_upload_info",
    _info_sql("lineitem", [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
                           ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                           ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]),
)
def a10(spark, sf):
    return profile.column_info(table(spark, sf, "lineitem"))


@query(
    "A11_filter_options",
    """WITH c AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL
                  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL)
       SELECT name, 'dimension' AS role, CAST(k AS BIGINT) AS rank, value FROM (
         SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS k FROM c) WHERE k <= 15
       UNION ALL SELECT 'o_orderdate', 'date', NULL, NULL""",
)
def a11(spark, sf):
    orders = table(spark, sf, "orders")
    return profile.filter_options(orders, semantics.infer_semantics(orders, with_grain=False))


# --- semantic model --------------------------------------------------------------------------

_HINTS = {
    "geo": "country state city region postal zip latitude longitude lat lon",
    "ids": "id uuid key code number no sku ticket",
    "cur": "revenue sales price cost profit income amount spend expense gmv",
    "pct": "percent percentage pct rate ratio share conversion",
    "cnt": "count qty quantity volume units visits orders sessions users",
    "dat": "date time month year day week quarter",
    "txt": "description comment notes message summary",
    "boo": "is_ has_ flag enabled active status",
}


def _hint(key: str) -> str:
    return "(" + " OR ".join(f"contains(lower(name), '{h}')" for h in _HINTS[key].split()) + ")"


def _stats_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        seq = (
            f"(count(*) FILTER ({c} <> floor({c})) = 0 AND count(DISTINCT {c}) >= 3 AND max({c}) - min({c}) + 1 = count(DISTINCT {c}))"
            if kind == "numeric"
            else "false"
        )
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, '{kind}' AS kind, count(*) AS n, count({c}) AS p, "
            f"count(DISTINCT {c}) AS u, {seq} AS is_seq FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _semantic_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return f"""
      WITH s AS ({_stats_sql(source, columns)}),
      a AS (SELECT *, u / greatest(p, 1) AS ur, kind = 'datetime' OR {_hint('dat')} AS is_date, kind = 'numeric' AS is_num,
                   ({_hint('ids')} AND u / greatest(p, 1) > 0.9) OR ends_with(lower(name), '_id') AS idn, {_hint('boo')} AS flag FROM s),
      b AS (SELECT *, CASE WHEN is_date THEN 'datetime' WHEN is_num THEN CASE WHEN idn OR is_seq THEN 'identifier' ELSE 'measure' END
                           WHEN NOT flag AND idn THEN 'identifier' ELSE 'dimension' END AS role FROM a),
      c AS (SELECT *, CASE WHEN is_date OR NOT is_num THEN 'categorical' WHEN role = 'identifier' THEN 'identifier'
                           WHEN {_hint('pct')} THEN 'percentage' WHEN {_hint('cur')} THEN 'currency' WHEN {_hint('cnt')} THEN 'count'
                           WHEN flag THEN 'boolean' ELSE 'numeric' END AS family,
                      CASE WHEN u <= 1 THEN 'constant' WHEN u <= 12 THEN 'low' WHEN u <= 50 OR u / greatest(n, 1) <= 0.15 THEN 'medium'
                           WHEN u / greatest(n, 1) >= 0.85 THEN 'very_high' ELSE 'high' END AS band FROM b)
      SELECT name, role AS semantic_role,
             CASE WHEN is_date THEN 'date' WHEN is_num THEN family WHEN flag THEN 'boolean' WHEN idn THEN 'identifier'
                  WHEN {_hint('geo')} THEN 'geography'
                  WHEN {_hint('txt')} AND u > greatest(20, floor(n * 0.3)) THEN 'text' ELSE 'category' END AS subtype,
             family AS metric_family, CAST(u AS BIGINT) AS unique_count, CAST(printf('%.4f', CAST(ur AS DOUBLE)) AS DOUBLE) AS uniqueness_ratio,
             CASE WHEN role = 'datetime' THEN 'none' WHEN role = 'identifier' THEN 'count_distinct'
                  WHEN role = 'measure' THEN CASE WHEN family IN ('percentage', 'boolean') THEN 'average' ELSE 'sum' END
                  ELSE 'count' END AS default_aggregation,
             role = 'measure' AND family IN ('currency', 'count', 'numeric') AS is_additive,
             CASE WHEN is_date THEN 'date' WHEN family = 'currency' THEN 'currency' WHEN family = 'percentage' THEN 'percentage'
                  WHEN family = 'count' THEN 'integer' ELSE 'number' END AS format_hint,
             band AS cardinality_band,
             CASE WHEN role = 'measure' THEN CASE WHEN family = 'currency' THEN 95 WHEN family = 'percentage' THEN 82 WHEN u > 1 THEN 90 ELSE 40 END
                  WHEN role = 'datetime' THEN 88 WHEN role = 'dimension' THEN CASE WHEN band IN ('low', 'medium') THEN 80 ELSE 58 END
                  ELSE 42 END AS analysis_priority
      FROM c"""


_SEMANTIC_COLUMNS = [
    "name", "semantic_role", "subtype", "metric_family", "unique_count", "uniqueness_ratio", "default_aggregation",
    "is_additive", "format_hint", "cardinality_band", "analysis_priority",
]
_KINDS = {
    "orders": ["numeric", "numeric", "text", "numeric", "datetime", "text"],
    "lineitem": ["numeric"] * 8 + ["text", "text", "datetime"],
    "customer": ["numeric", "text", "numeric", "numeric", "text"],
}


def _typed(name: str) -> list[tuple[str, str]]:
    return list(zip(TABLES[name], _KINDS[name]))


def _register_semantics(name: str) -> None:
    @query(f"M1_semantic_roles_{name}", _semantic_sql(name, _typed(name)))
    def run(spark, sf):
        return semantics.infer_semantics(table(spark, sf, name), with_grain=False).select(*_SEMANTIC_COLUMNS)


for _name in _KINDS:
    _register_semantics(_name)


@query(
    "M1_semantic_roles_events",
    _semantic_sql("events", [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "text"), ("value", "numeric"), ("props", "text")]),
)
def m1_events(spark, sf):
    return semantics.infer_semantics(table(spark, sf, "events"), with_grain=False).select(*_SEMANTIC_COLUMNS)


@query(
    "M2_cardinality_bands",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CASE WHEN u <= 1 THEN 'constant' WHEN u <= 12 THEN 'low' WHEN u <= 50 OR u / n <= 0.15 THEN 'medium'
                   WHEN u / n >= 0.85 THEN 'very_high' ELSE 'high' END AS cardinality_band
            FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM documents)"""
        for c in TABLES["documents"]
    ),
)
def m2(spark, sf):
    stats = semantics.column_stats(table(spark, sf, "documents"))
    return stats.select("name", semantics.cardinality_band(F.col("unique_count"), F.col("rows")).alias("cardinality_band"))


@query("M3_sequences", f"SELECT name, is_seq AS is_sequence FROM ({_stats_sql('customer', _typed('customer'))})")
def m3(spark, sf):
    return semantics.column_stats(table(spark, sf, "customer")).select("name", "is_sequence")


def _grain_sql(source: str, column: str) -> str:
    return f"""
      SELECT '{column}' AS name, round(d, 8) AS median_gap_days,
             CASE WHEN d IS NULL THEN 'unknown' WHEN d < 1.0 / 24 THEN 'sub-hourly' WHEN d < 1 THEN 'hourly' WHEN d <= 2 THEN 'daily'
                  WHEN d <= 8 THEN 'weekly' WHEN d <= 32 THEN 'monthly' WHEN d <= 100 THEN 'quarterly' ELSE 'yearly' END AS time_grain
      FROM (SELECT median((epoch_us(t) - epoch_us(b)) / 1000000.0) / 86400 AS d
            FROM (SELECT {column} AS t, lag({column}) OVER (ORDER BY {column}) AS b FROM {source}) WHERE b IS NOT NULL)"""


@query("M4_time_grain_events", _grain_sql("events", "ts"))
def m4(spark, sf):
    return semantics.time_grain(table(spark, sf, "events"), "ts").withColumn("median_gap_days", F.round("median_gap_days", 8))


@query("M4_time_grain_days", _grain_sql("(SELECT DISTINCT o_orderdate FROM orders)", "o_orderdate"))
def m4_days(spark, sf):
    days = table(spark, sf, "orders").select("o_orderdate").distinct()
    return semantics.time_grain(days, "o_orderdate").withColumn("median_gap_days", F.round("median_gap_days", 8))


@query(
    "M5_metric_families",
    f"""SELECT name, CASE WHEN {_hint('pct')} THEN 'percentage' WHEN {_hint('cur')} THEN 'currency' WHEN {_hint('cnt')} THEN 'count'
               WHEN {_hint('boo')} THEN 'boolean' ELSE 'numeric' END AS metric_family, CAST(n AS BIGINT) AS values
        FROM ({" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM lineitem" for c in TABLES["lineitem"][:8])})""",
)
def m5(spark, sf):
    stats = semantics.column_stats(table(spark, sf, "lineitem").select(*TABLES["lineitem"][:8]), approximate=True)
    return stats.select(
        "name", semantics.metric_family(F.lower("name"), F.col("kind")).alias("metric_family"), F.col("non_null_count").alias("values")
    )


def _m6_sql() -> str:
    """The first level, in the order of the templates, that a column's name contains."""
    steps = [(h, levels[i], ",".join(levels[i + 1 :])) for h, levels in semantics.HIERARCHIES.items() for i in range(len(levels))]
    listed = ", ".join(f"({k}, '{h}', '{level}', '{rest}')" for k, (h, level, rest) in enumerate(steps))
    sources = {"o_orderdate": "o_orderdate", "region_name": "o_orderstatus", "p_brand": "o_orderstatus", "team": "o_orderpriority", "o_totalprice": "o_totalprice"}
    columns = " UNION ALL ".join(f"SELECT '{name}' AS name, count({c}) AS present FROM orders" for name, c in sources.items())
    return f"""WITH c AS ({columns}), l(k, h, level, rest) AS (VALUES {listed}),
                    m AS (SELECT name, arg_min(struct_pack(h := h, level := level, rest := rest), k) AS f FROM c JOIN l ON contains(name, level) GROUP BY name)
               SELECT c.name, f.h AS hierarchy, f.level AS level, f.rest AS next_levels, present FROM c LEFT JOIN m ON m.name = c.name"""


@query("M6_hierarchies", _m6_sql())
def m6(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderdate", F.col("o_orderstatus").alias("region_name"), F.col("o_orderstatus").alias("p_brand"),
        F.col("o_orderpriority").alias("team"), "o_totalprice",
    )
    stats = semantics.column_stats(orders, approximate=True)
    hint = semantics.hierarchy_hint(F.lower("name"))
    return stats.withColumn("h", hint).select(
        "name", F.col("h.name").alias("hierarchy"), F.col("h.level").alias("level"),
        F.array_join("h.next_levels", ",").alias("next_levels"), F.col("non_null_count").alias("present"),
    )


_OVERRIDES = {
    "o_totalprice": {"business_name": "Revenue", "certified": True, "default_aggregation": "average", "other": "x"},
    "o_custkey": {"semantic_role": "identifier", "subtype": "identifier", "analysis_priority": 42, "description": ""},
}


@query(
    "M7_overrides",
    f"""SELECT name, CASE WHEN name = 'o_custkey' THEN 'identifier' ELSE semantic_role END AS semantic_role,
               CASE WHEN name = 'o_custkey' THEN 'identifier' ELSE subtype END AS subtype,
               CASE WHEN name = 'o_totalprice' THEN 'average' ELSE default_aggregation END AS default_aggregation,
               CASE WHEN name = 'o_custkey' THEN 42 ELSE analysis_priority END AS analysis_priority,
               name = 'o_totalprice' AS certified, CASE WHEN name = 'o_totalprice' THEN 'Revenue' ELSE name END AS business_name,
               CASE WHEN name IN ('o_totalprice', 'o_custkey') THEN 'manual' ELSE 'inferred' END AS override_source
        FROM ({_semantic_sql("orders", _typed("orders"))})""",
)
def m7(spark, sf):
    profiles = semantics.infer_semantics(table(spark, sf, "orders"), _OVERRIDES, with_grain=False)
    return profiles.select(
        "name", "semantic_role", "subtype", "default_aggregation", "analysis_priority", "certified", "business_name", "override_source"
    )


_EVENT_KINDS = [
    ("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "text"), ("value", "numeric"), ("props", "text"),
]


@query(
    "M8_semantic_profile",
    f"""SELECT s.*, g.time_grain, 'inferred' AS override_source, false AS certified, s.name AS business_name
        FROM ({_semantic_sql("events", _EVENT_KINDS)}) s LEFT JOIN ({_grain_sql("events", "ts")}) g ON g.name = s.name""",
)
def m8(spark, sf):
    profiles = semantics.infer_semantics(table(spark, sf, "events"))
    return profiles.select(*_SEMANTIC_COLUMNS, "time_grain", "override_source", "certified", "business_name")


@query(
    "M9_dataset_model",
    f"""WITH p AS ({_semantic_sql("orders", _typed("orders"))}),
             k AS (SELECT *, row_number() OVER () AS pos FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) t(name))
        SELECT CASE WHEN count(*) FILTER (semantic_role = 'measure') > 0 AND ((SELECT count(*) FROM orders) >= 25 OR count(*) FILTER (semantic_role = 'measure') >= 2) THEN 'fact' ELSE 'other' END AS dataset_role,
               string_agg(name, ' + ' ORDER BY pos) FILTER (semantic_role = 'identifier' AND uniqueness_ratio >= 0.9) AS row_grain,
               min(name) FILTER (semantic_role = 'datetime') AS primary_date_column,
               string_agg(name, ',' ORDER BY analysis_priority DESC, pos) FILTER (semantic_role = 'measure') AS recommended_measures,
               string_agg(name, ',' ORDER BY analysis_priority DESC, pos) FILTER (semantic_role = 'dimension' AND cardinality_band IN ('low', 'medium')) AS recommended_dimensions,
               CAST(count(*) FILTER (semantic_role = 'measure') AS BIGINT) AS measures, CAST(count(*) FILTER (semantic_role = 'dimension') AS BIGINT) AS dimensions,
               CAST(count(*) FILTER (semantic_role = 'datetime') AS BIGINT) AS datetimes, CAST(count(*) FILTER (semantic_role = 'identifier') AS BIGINT) AS identifiers,
               CAST(0 AS BIGINT) AS manual_override_count
        FROM p JOIN k USING (name)""",
)
def m9(spark, sf):
    orders = table(spark, sf, "orders")
    model = semantics.dataset_model(
        semantics.infer_semantics(orders, with_grain=False), orders.agg(F.count(F.lit(1))).scalar()
    )
    return model.select(
        "dataset_role", "row_grain", "primary_date_column",
        F.array_join("recommended_measures", ",").alias("recommended_measures"),
        F.array_join("recommended_dimensions", ",").alias("recommended_dimensions"),
        "measures", "dimensions", "datetimes", "identifiers", "manual_override_count",
    )
