"""Business measures and chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.functions.quantiles import quantiles
from prismtally.operators import charts, measures
from prismtally.queries.registry import query, table

# --- measures ---------------------------------------------------------------------------------


@query(
    "B1_ratio",
    "SELECT 'price per unit' AS name, 'ratio' AS type, round(sum(l_extendedprice) / sum(l_quantity), 4) AS value FROM lineitem",
)
def b1(spark, sf):
    definition = {"name": "price per unit", "type": "ratio", "numerator": "l_extendedprice", "denominator": "l_quantity"}
    return measures.evaluate_measure(table(spark, sf, "lineitem"), definition)


def _charged(spark, sf):
    return table(spark, sf, "lineitem").withColumn("cost", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(
    "B2_margin",
    """SELECT l_returnflag, 'margin' AS name, 'margin' AS type,
              round((sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount))) / sum(l_extendedprice) * 100, 4) AS value
       FROM lineitem GROUP BY l_returnflag""",
)
def b2(spark, sf):
    return measures.evaluate_measure(
        _charged(spark, sf), {"type": "margin", "revenue": "l_extendedprice", "cost": "cost"}, by=["l_returnflag"]
    )


@query(
    "B3_conversion_rate",
    """SELECT 'conversion_rate' AS name, 'conversion_rate' AS type,
              round(sum(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) / sum(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) * 100, 4) AS value
       FROM events""",
)
def b3(spark, sf):
    flags = table(spark, sf, "events").select(
        (F.col("event_type") == "purchase").alias("bought"), (F.col("event_type") == "view").cast("int").alias("viewed")
    )
    return measures.evaluate_measure(flags, {"type": "conversion_rate", "converted": "bought", "total": "viewed"})


_DAILY = "SELECT o_orderdate AS d, sum(o_totalprice) AS t FROM orders GROUP BY 1"
_METRIC = {"metric": "o_totalprice", "date_column": "o_orderdate"}


@query(
    "B4_growth_pct",
    f"""WITH t AS ({_DAILY}) SELECT 'growth_pct' AS name, 'growth_pct' AS type,
        round((max_by(t, d) - min_by(t, d)) / abs(min_by(t, d)) * 100, 4) AS value FROM t""",
)
def b4(spark, sf):
    return measures.evaluate_measure(table(spark, sf, "orders"), {"type": "growth_pct", **_METRIC})


@query(
    "B5_rolling_average",
    f"""SELECT 'rolling_average' AS name, 'rolling_average' AS type, round(avg(t), 4) AS value
        FROM (SELECT * FROM ({_DAILY}) ORDER BY d DESC LIMIT 7)""",
)
def b5(spark, sf):
    return measures.evaluate_measure(table(spark, sf, "orders"), {"type": "rolling_average", **_METRIC})


@query(
    "B5_rolling_series",
    """WITH t AS (SELECT o_orderpriority, o_orderdate AS period, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
       SELECT o_orderpriority, period, round(total, 2) AS total,
              round(avg(total) OVER (PARTITION BY o_orderpriority ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS rolling FROM t""",
)
def b5_series(spark, sf):
    series = measures.rolling_series(table(spark, sf, "orders"), {"window": 7, **_METRIC}, ["o_orderpriority"])
    return series.select(
        "o_orderpriority", "period", F.round("total", 2).alias("total"), F.round("rolling", 2).alias("rolling")
    )


def _period_sql(unit: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
      WITH t AS (SELECT {keys}date_trunc('{unit}', o_orderdate) AS p, sum(o_totalprice) AS t FROM orders GROUP BY ALL),
           r AS (SELECT *, row_number() OVER ({part}ORDER BY p DESC) AS age FROM t)
      SELECT {keys}'period_change' AS name, 'period_change' AS type,
             round((max(t) FILTER (age = 1) - max(t) FILTER (age = 2)) / abs(max(t) FILTER (age = 2)) * 100, 4) AS value
      FROM r WHERE age <= 2 {group}"""


@query("B6_period_change_month", _period_sql("month"))
def b6_month(spark, sf):
    return measures.evaluate_measure(table(spark, sf, "orders"), {"type": "period_change", "grain": "M", **_METRIC})


@query("B6_period_change_quarter", _period_sql("quarter", "o_orderpriority"))
def b6_quarter(spark, sf):
    definition = {"type": "period_change", "grain": "Q", **_METRIC}
    return measures.evaluate_measure(table(spark, sf, "orders"), definition, by=["o_orderpriority"])


@query("B6_period_change_year", _period_sql("year"))
def b6_year(spark, sf):
    return measures.evaluate_measure(table(spark, sf, "orders"), {"type": "period_change", "grain": "Y", **_METRIC})


@query(
    "B7_explained",
    """SELECT 'rebate' AS name, 'ratio' AS type, round(sum(l_discount) / sum(l_quantity), 4) AS value, 'sum of l_discount over sum of l_quantity' AS explanation FROM lineitem
       UNION ALL SELECT 'growth', 'growth_pct', round((arg_max(t, d) - arg_min(t, d)) / abs(arg_min(t, d)) * 100, 4), 'o_totalprice at the last o_orderdate against the first, in percent'
       FROM (SELECT o_orderdate AS d, sum(o_totalprice) AS t FROM orders GROUP BY 1)""",
)
def b7_explained(spark, sf):
    rebate = {"name": "rebate", "type": "ratio", "numerator": "l_discount", "denominator": "l_quantity"}
    growth = {"name": "growth", "type": "growth_pct", "metric": "o_totalprice", "date_column": "o_orderdate"}
    first = measures.evaluate_measure(table(spark, sf, "lineitem"), rebate, explain=True)
    return first.unionByName(measures.evaluate_measure(table(spark, sf, "orders"), growth, explain=True))


@query(
    "B7_many_measures",
    """SELECT l_shipmode AS l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit_price,
              round((sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount))) / sum(l_extendedprice) * 100, 4) AS margin,
              round(sum(l_tax) / sum(l_quantity) * 100, 4) AS tax_rate, CAST(NULL AS DOUBLE) AS impossible
       FROM (SELECT l_linestatus AS l_shipmode, * EXCLUDE (l_linestatus) FROM lineitem) GROUP BY 1""",
)
def b7(spark, sf):
    rows = _charged(spark, sf).withColumn("zero", F.lit("none"))
    definitions = [
        {"name": "unit_price", "type": "ratio", "numerator": "l_extendedprice", "denominator": "l_quantity"},
        {"name": "margin", "type": "margin", "revenue": "l_extendedprice", "cost": "cost"},
        {"name": "tax_rate", "type": "conversion_rate", "converted": "l_tax", "total": "l_quantity"},
        {"name": "impossible", "type": "ratio", "numerator": "l_tax", "denominator": "zero"},
    ]
    return measures.evaluate_sum_measures(rows, definitions, by=["l_linestatus"])


# --- charts -----------------------------------------------------------------------------------


@query("C1_value_counts", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def c1(spark, sf):
    return charts.chart(table(spark, sf, "orders"), ["o_orderpriority"], "bar")


@query(
    "C2_sum_bars",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' GROUP BY 1""",
)
def c2(spark, sf):
    filters = {"date_column": "o_orderdate", "start_date": "1996-01-01", "end_date": "1996-12-31"}
    bars = charts.chart(table(spark, sf, "orders"), ["o_orderpriority", "o_totalprice"], "bar", filters=filters)
    return bars.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("C2_count_bars", "SELECT o_orderpriority, CAST(count(o_orderstatus) AS BIGINT) AS o_orderstatus FROM orders GROUP BY 1")
def c2_count(spark, sf):
    return charts.chart(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "bar")


@query("C3_line", "SELECT o_orderdate, o_totalprice, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def c3(spark, sf):
    filters = {"column": "o_orderstatus", "value": "P"}
    return charts.chart(table(spark, sf, "orders"), ["o_orderdate", "o_totalprice", "o_custkey"], "line", filters=filters)


@query(
    "C3_line_months",
    "SELECT date_trunc('month', o_orderdate) AS o_orderdate, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1",
)
def c3_months(spark, sf):
    line = charts.line_buckets(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"])
    return line.select(F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "C4_scatter_band",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i,
                         sqrt(var_pop(l_extendedprice) * (1 - corr(l_extendedprice, l_quantity) ** 2)) AS e FROM lineitem)
       SELECT l_quantity, l_extendedprice, round(i + s * l_quantity, 3) AS fitted,
              round(i + s * l_quantity + 1.96 * e, 3) AS upper, round(i + s * l_quantity - 1.96 * e, 3) AS lower FROM lineitem, f""",
)
def c4(spark, sf):
    points = charts.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return points.select("l_quantity", "l_extendedprice", *[F.round(c, 3).alias(c) for c in ("fitted", "upper", "lower")])


@query(
    "C4_linear_fit",
    """SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
              round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 8) AS r,
              round(corr(l_extendedprice, l_quantity) ** 2, 8) AS r_squared,
              round(sqrt(var_pop(l_extendedprice) * (1 - corr(l_extendedprice, l_quantity) ** 2)), 4) AS residual_std FROM lineitem""",
)
def c4_fit(spark, sf):
    digits = {"slope": 6, "intercept": 4, "r": 8, "r_squared": 8, "residual_std": 4}
    fit = charts.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.select("n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("C5_pie", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1")
def c5(spark, sf):
    pie = charts.chart(table(spark, sf, "customer"), ["c_mktsegment", "c_acctbal"], "pie")
    return pie.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("C5_pie_counts", "SELECT lang, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY 1")
def c5_counts(spark, sf):
    return charts.chart(table(spark, sf, "documents"), ["lang", "source"], "pie")


_BINS = """s AS (SELECT count(*) AS n, min({x}) AS lo, max({x}) AS hi, avg({x}) AS mean, stddev_samp({x}) AS std,
                        quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr FROM {t}),
           b AS (SELECT *, greatest(CASE WHEN iqr > 0 THEN CAST(trunc((hi - lo) / (2 * iqr / n ** (1.0 / 3))) AS BIGINT)
                                         ELSE least(greatest(CAST(trunc(sqrt(n)) AS BIGINT), 10), 60) END, 5) AS bins FROM s)"""


@query(
    "C6_histogram",
    f"""WITH {_BINS.format(x="l_extendedprice", t="lineitem")}
        SELECT bin, round(any_value(lo + bin * (hi - lo) / bins), 4) AS bin_start, round(any_value(lo + (bin + 1) * (hi - lo) / bins), 4) AS bin_end,
               CAST(count(*) AS BIGINT) AS count
        FROM (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, lo, hi, bins FROM lineitem, b)
        GROUP BY bin""",
)
def c6(spark, sf):
    bins = charts.chart(table(spark, sf, "lineitem"), ["l_extendedprice"], "histogram")
    return bins.select("bin", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"), "count")


@query(
    "C7_normal_overlay",
    f"""WITH {_BINS.format(x="l_extendedprice", t="lineitem")}
        SELECT CAST(k AS BIGINT) AS point, round(lo + k * (hi - lo) / 99, 4) AS x,
               round(exp(-0.5 * ((lo + k * (hi - lo) / 99 - mean) / std) ** 2) / (std * sqrt(2 * pi())) * n * (hi - lo) / bins, 4) AS y
        FROM range(100) r(k), b""",
)
def c7(spark, sf):
    overlay = charts.normal_overlay(table(spark, sf, "lineitem"), "l_extendedprice")
    return overlay.select("point", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    "C8_box_outliers",
    """WITH e AS (SELECT event_id, value * value AS squared FROM events),
            q AS (SELECT quantile_cont(squared, 0.25) AS a, quantile_cont(squared, 0.75) AS b FROM e)
       SELECT event_id, round(squared, 4) AS squared FROM e, q WHERE squared > b + 1.5 * (b - a) OR squared < a - 1.5 * (b - a)""",
)
def c8(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") * F.col("value")).alias("squared"))
    return charts.box_outliers(rows, "squared").withColumn("squared", F.round("squared", 4))


_BOX = """CAST(count({y}) AS BIGINT) AS n, round(min({y}), 4) AS min, round(quantile_cont({y}, 0.25), 4) AS q1,
          round(median({y}), 4) AS median, round(quantile_cont({y}, 0.75), 4) AS q3, round(max({y}), 4) AS max,
          round(avg({y}), 4) AS mean, round(stddev_samp({y}), 4) AS std, round(skewness({y}), 4) AS skewness,
          round(kurtosis({y}), 4) AS kurtosis"""
_BOX_COLUMNS = ["min", "q1", "median", "q3", "max", "mean", "std", "skewness", "kurtosis"]


def _rounded(df, keys: list[str]):
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in _BOX_COLUMNS])


@query("C8_box", f"SELECT {_BOX.format(y='l_extendedprice')} FROM lineitem")
def c8_box(spark, sf):
    return _rounded(charts.chart(table(spark, sf, "lineitem"), ["l_extendedprice"], "box"), ["n"])


@query("C9_box_by_group", f"SELECT l_returnflag, {_BOX.format(y='l_quantity')} FROM lineitem GROUP BY 1")
def c9(spark, sf):
    return _rounded(charts.chart(table(spark, sf, "lineitem"), ["l_returnflag", "l_quantity"], "box"), ["l_returnflag", "n"])


@query("C10_kpi", "SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS average FROM lineitem")
def c10(spark, sf):
    card = charts.chart(table(spark, sf, "lineitem"), ["l_extendedprice"], "kpi")
    return card.select(F.round("total", 2).alias("total"), F.round("average", 4).alias("average"))


@query(
    "C11_heatmap_sums",
    """SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS "F",
              round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS "O",
              round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS "P" FROM orders GROUP BY 1""",
)
def c11(spark, sf):
    wide = charts.chart(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_totalprice"], "heatmap")
    return wide.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in ("F", "O", "P")])


@query(
    "C12_heatmap_counts",
    """SELECT coalesce(l_linestatus, 'nan') AS l_linestatus, CAST(count(*) FILTER (flag = 'A') AS BIGINT) AS "A",
              CAST(count(*) FILTER (flag = 'N') AS BIGINT) AS "N", CAST(count(*) FILTER (flag = 'nan') AS BIGINT) AS "nan"
       FROM (SELECT l_linestatus, coalesce(nullif(l_returnflag, 'R'), 'nan') AS flag FROM lineitem) GROUP BY 1""",
)
def c12(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.expr("nullif(l_returnflag, 'R')").alias("flag"), "l_linestatus")
    return charts.chart(rows, ["flag", "l_linestatus"], "heatmap")


@query(
    "C12_heatmap_long",
    """SELECT l_linestatus AS "row", l_returnflag AS "column", CAST(count(*) AS BIGINT) AS value FROM lineitem GROUP BY ALL""",
)
def c12_long(spark, sf):
    return charts.heatmap_long(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


_PAIRS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "C13_correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 8) AS r, CAST(count(*) AS BIGINT) AS n FROM lineitem"
        for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :]
    ),
)
def c13(spark, sf):
    return charts.correlation_matrix(table(spark, sf, "lineitem")).withColumn("r", F.round("r", 8))


@query(
    "C14_annotations",
    """SELECT round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS std,
              round(skewness(c_acctbal), 4) AS skewness, round(kurtosis(c_acctbal), 4) AS kurtosis FROM customer""",
)
def c14(spark, sf):
    noted = charts.annotations(table(spark, sf, "customer"), "c_acctbal")
    return noted.select(*[F.round(c, 4).alias(c) for c in noted.columns])


@query(
    "C15_category_batch",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY ALL""",
)
def c15(spark, sf):
    return charts.category_batch(table(spark, sf, "orders"))


@query(
    "C15_dashboard",
    f"""WITH {_BINS.format(x="o_totalprice", t="orders")}
        SELECT 'spread' AS chart, 'o_totalprice' AS part, CAST(CAST(least(floor((o_totalprice - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS VARCHAR) AS label,
               CAST(count(*) AS DOUBLE) AS value FROM orders, b GROUP BY 3
        UNION ALL SELECT 'mix', 'o_orderstatus', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 3
        UNION ALL SELECT 'mix', 'o_orderpriority', o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 3
        UNION ALL SELECT 'trend', 'o_orderdate_o_totalprice', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), round(o_totalprice, 6) FROM orders
        UNION ALL SELECT 'links', 'matrix', 'o_totalprice o_custkey', round(corr(o_totalprice, o_custkey), 6) FROM orders""",
)
def c15_dashboard(spark, sf):
    """All chart datasets of a dashboard definition, as one long table of their points."""
    config = {
        "visualizations": [
            {"id": "spread", "type": "distribution", "columns": ["o_totalprice", "o_orderstatus"]},
            {"id": "mix", "type": "categorical", "columns": ["o_orderstatus", "o_orderpriority"]},
            {"id": "trend", "type": "time_series", "columns": ["o_totalprice"]},
            {"id": "links", "type": "correlation", "columns": ["o_totalprice", "o_custkey"]},
        ]
    }
    built = charts.dashboard(table(spark, sf, "orders"), config)["visualizations"]
    points = {
        "spread": ("bin", "count"),
        "trend": ("o_orderdate", "o_totalprice"),
        "links": (None, "r"),
    }
    parts = []
    for chart_id, found in built.items():
        for name, df in (found if isinstance(found, dict) else {"matrix": found}).items():
            label, value = points.get(chart_id, (name, "count"))
            text = F.concat_ws(" ", "left", "right") if label is None else F.col(label).cast("string")
            parts.append(df.select(F.lit(chart_id).alias("chart"), F.lit(name).alias("part"), text.alias("label"), F.round(F.col(value).cast("double"), 6).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "C9_selected_quartiles",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
              round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY ALL""",
)
def c9_selected(spark, sf):
    """Grouped quartiles by the selection that large tables take."""
    found = quantiles(table(spark, sf, "lineitem"), {"q": F.col("l_extendedprice")}, [0.25, 0.5, 0.75], by=["l_returnflag", "l_linestatus"], builtin_values=0)
    return found.select("l_returnflag", "l_linestatus", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
