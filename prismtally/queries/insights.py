"""Insight detectors (I1-I19): their statistics tables and their findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.functions.scoring import enrich
from prismtally.functions.stats import anova, with_f_p_value
from prismtally.operators.insights import drivers, foundational, journeys, segments, series
from prismtally.operators.insights.common import month_totals, segment_stats
from prismtally.operators import profile
from prismtally.plans import summary
from prismtally.queries.registry import (
    FINDING_COLUMNS,
    ORACLES,
    confidence_sql,
    f_upper_sql,
    query,
    scored_sql,
    t_two_sided_sql,
    table,
)


def _lines(spark, sf):
    """Line items with derived amounts that correlate and separate."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
        "l_quantity",
        "l_extendedprice",
        (price * (1 - discount)).alias("net"),
        F.when(F.col("l_returnflag") == "R", price * 3).otherwise(price * discount).alias("swing"),
    )


_LINES = """(SELECT l_returnflag, l_linestatus, l_shipdate, l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net,
                    CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 3 ELSE l_extendedprice * l_discount END AS swing FROM lineitem)"""


def _findings(df):
    return df.select(*FINDING_COLUMNS)


# --- I1-I4 --------------------------------------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "net", "swing"]
_PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM {_LINES}"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]
)


@query("I1_correlation_pairs", f"SELECT a AS \"left\", b AS \"right\", round(r, 8) AS r, CAST(n AS BIGINT) AS n FROM ({_PAIR_ROWS})")
def i1_pairs(spark, sf):
    return foundational.correlation_table(_lines(spark, sf)).withColumn("r", F.round("r", 8))


@query(
    "I1_correlation_insights",
    scored_sql(
        f"""SELECT 'correlation' AS kind, a || ' and ' || b || ' move together' AS title,
                   'Their linear correlation is ' || printf('%.2f', r) || '; look for what ties them together.' AS detail,
                   round(abs(r), 3) AS score, 'r = ' || printf('%.2f', r) AS stat, n AS sample, abs(r) AS effect,
                   {t_two_sided_sql('r', 'n')} AS p, NULL AS stability
            FROM ({_PAIR_ROWS}) WHERE abs(r) >= 0.45 AND n >= 12""",
        3,
    ),
)
def i1(spark, sf):
    return _findings(foundational.correlation_insights(_lines(spark, sf)))


_SKEW_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS name, skewness({c}) AS s, count({c}) AS n FROM {_LINES}" for c in _NUM)


@query(
    "I2_distribution_insights",
    scored_sql(
        f"""SELECT 'distribution' AS kind, name || ' has a ' || CASE WHEN s > 0 THEN 'right' ELSE 'left' END || '-skewed distribution' AS title,
                   'A few values far out pull the mean away from the bulk, so the median describes it better.' AS detail,
                   round(abs(s), 3) AS score, 'skew = ' || printf('%.2f', s) AS stat, n AS sample, least(abs(s) / 2.5, 2.0) AS effect,
                   CAST(NULL AS DOUBLE) AS p, least(1.0, abs(s) / 3) AS stability
            FROM ({_SKEW_ROWS}) WHERE abs(s) >= 1 AND n >= 8""",
        2,
    ),
)
def i2(spark, sf):
    return _findings(foundational.distribution_insights(_lines(spark, sf)))


_CONCENTRATION = """
  WITH c AS (SELECT 'l_returnflag' AS name, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL
             UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL
             UNION ALL SELECT 'big', CASE WHEN l_quantity > 5 THEN 'big' ELSE 'small' END, count(*) FROM lineitem GROUP BY ALL),
  s AS (SELECT name, count(*) AS k, sum(n) AS t, max(n) AS top, arg_min(v, (-n, v)) AS label FROM c GROUP BY name)
  SELECT s.name, CAST(k AS BIGINT) AS categories, CAST(t AS BIGINT) AS n, label, CAST(top AS BIGINT) AS top,
         CAST(printf('%.2f', CAST(top / t * 100 AS DOUBLE)) AS DOUBLE) AS dominance, -sum(c.n / t * ln(c.n / t)) AS entropy
  FROM s JOIN c ON c.name = s.name GROUP BY ALL"""


def _categories(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 5, "big").otherwise("small").alias("big")
    )


@query("I3_concentration_table", f"SELECT * REPLACE (round(entropy, 8) AS entropy) FROM ({_CONCENTRATION})")
def i3_table(spark, sf):
    return foundational.concentration_table(_categories(spark, sf)).withColumn("entropy", F.round("entropy", 8))


@query(
    "I3_concentration_insights",
    scored_sql(
        f"""SELECT 'categorical' AS kind, name || ' is concentrated in ''' || label || '''' AS title,
                   'This one value stands in ' || CAST(CAST(dominance AS DOUBLE) AS VARCHAR) || '% of the rows that have one.' AS detail,
                   dominance AS score, label || ': ' || CAST(CAST(dominance AS DOUBLE) AS VARCHAR) || '%' AS stat, n AS sample,
                   greatest(dominance / 100, 1 - least(entropy, 3.0) / 3) AS effect, CAST(NULL AS DOUBLE) AS p, least(1.0, dominance / 70) AS stability
            FROM ({_CONCENTRATION}) WHERE dominance >= 35""",
        2,
    ),
)
def i3(spark, sf):
    return _findings(foundational.concentration_insights(_categories(spark, sf)))


def _trend_sql(measure: str, agg: str, source: str = "orders", date: str = "o_orderdate") -> str:
    return f"""
      SELECT '{date}' AS date_column, '{measure}' AS measure, sum(n) AS rows, count(*) AS periods, regr_slope(y, x) AS slope, corr(y, x) AS r,
             arg_min(y, x) AS first, arg_max(y, x) AS last
      FROM (SELECT {agg}({measure}) AS y, count({measure}) AS n, row_number() OVER (ORDER BY {date}) - 1 AS x FROM {source} GROUP BY {date})"""


@query(
    "I4_trend_table",
    f"""SELECT date_column, measure, CAST(rows AS BIGINT) AS rows, CAST(periods AS BIGINT) AS periods, round(slope, 4) AS slope, round(r, 8) AS r,
               round(first, 2) AS first, round(last, 2) AS last
        FROM ({_trend_sql('o_totalprice', 'sum')} UNION ALL {_trend_sql('o_custkey', 'avg')})""",
)
def i4_table(spark, sf):
    found = foundational.trend_table(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"], {"o_custkey"})
    return found.select(
        "date_column", "measure", "rows", "periods", F.round("slope", 4).alias("slope"), F.round("r", 8).alias("r"),
        F.round("first", 2).alias("first"), F.round("last", 2).alias("last"),
    )


@query(
    "I4_trend_events",
    f"""SELECT measure, CAST(rows AS BIGINT) AS rows, CAST(periods AS BIGINT) AS periods, round(slope, 8) AS slope, round(r, 8) AS r,
               round(first, 4) AS first, round(last, 4) AS last FROM ({_trend_sql('value', 'sum', 'events', 'ts')})""",
)
def i4_events(spark, sf):
    """As many distinct timestamps as rows."""
    found = foundational.trend_table(table(spark, sf, "events"), "ts", ["value"])
    return found.select(
        "measure", "rows", "periods", F.round("slope", 8).alias("slope"), F.round("r", 8).alias("r"),
        F.round("first", 4).alias("first"), F.round("last", 4).alias("last"),
    )


_RISING = "(SELECT o_orderdate, o_totalprice + date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 100.0 AS rising FROM orders)"


@query(
    "I4_trend_insights",
    scored_sql(
        f"""SELECT 'trend' AS kind, measure || ' changes over time' AS title,
                   'Between its first and its last period it changed by ' || CAST(CAST(round(d, 2) AS DOUBLE) AS VARCHAR) || ' (' || CAST(CAST(pct AS DOUBLE) AS VARCHAR) || '%).' AS detail,
                   greatest(abs(pct), abs(d)) AS score,
                   'change = ' || CAST(CAST(round(d, 2) AS DOUBLE) AS VARCHAR) || ' (' || CAST(CAST(pct AS DOUBLE) AS VARCHAR) || '%)' AS stat,
                   periods AS sample, greatest(abs(r), abs(pct) / 100) AS effect, {t_two_sided_sql('r', 'periods')} AS p, NULL AS stability
            FROM (SELECT *, last - first AS d, round((last - first) / CASE WHEN first = 0 THEN 1 ELSE abs(first) END * 100, 2) AS pct
                  FROM ({_trend_sql('rising', 'avg', _RISING)} UNION ALL {_trend_sql('o_custkey', 'avg')}))
            WHERE abs(r) >= 0.35 OR abs(pct) >= 10""",
        2,
    ),
)
def i4(spark, sf):
    """A measure that rises with the date, beside one that does not."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date"))
    orders = table(spark, sf, "orders").withColumn("rising", F.col("o_totalprice") + day * 100.0)
    found = foundational.trend_insights(orders, ["o_orderdate"], ["rising", "o_custkey"], {"rising", "o_custkey"})
    return _findings(found)


# --- I5-I8 --------------------------------------------------------------------------------------


def _spiky(spark, sf):
    """Event values with a heavy tail."""
    return table(spark, sf, "events").select((F.pow("value", 3) / 1000).alias("amount"), "value")


_ANOMALY = """
  WITH e AS (SELECT value ** 3 / 1000 AS amount, value FROM events),
  m AS (SELECT median(amount) AS md FROM e), d AS (SELECT median(abs(amount - md)) / 0.6744897501960817 AS s FROM e, m),
  z AS (SELECT amount, md, s, abs(0.6745 * (amount - md) / s) AS z FROM e, m, d),
  m2 AS (SELECT median(value) AS md FROM e), d2 AS (SELECT median(abs(value - md)) / 0.6744897501960817 AS s FROM e, m2),
  z2 AS (SELECT value AS amount, md, s, abs(0.6745 * (value - md) / s) AS z FROM e, m2, d2)
  SELECT 'amount' AS measure, count(*) AS n, any_value(md) AS median, any_value(s) AS mad, count(*) FILTER (z >= 3.5) AS outliers,
         arg_max(amount, abs(amount)) FILTER (z >= 3.5) AS top_value, max(z) AS max_z FROM z
  UNION ALL SELECT 'value', count(*), any_value(md), any_value(s), count(*) FILTER (z >= 3.5), arg_max(amount, abs(amount)) FILTER (z >= 3.5), max(z) FROM z2"""


@query(
    "I5_anomaly_table",
    f"""SELECT measure, CAST(n AS BIGINT) AS n, round(median, 6) AS median, round(mad, 6) AS mad, CAST(outliers AS BIGINT) AS outliers,
               round(top_value, 4) AS top_value, round(max_z, 6) AS max_z FROM ({_ANOMALY})""",
)
def i5_table(spark, sf):
    found = segments.anomaly_table(_spiky(spark, sf), ["amount", "value"])
    return found.select(
        "measure", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "outliers",
        F.round("top_value", 4).alias("top_value"), F.round("max_z", 6).alias("max_z"),
    )


@query(
    "I5_anomaly_insights",
    scored_sql(
        f"""SELECT 'anomaly' AS kind, measure || ' shows statistically unusual values' AS title,
                   'The value furthest from the median is ' || format('{{:,.2f}}', top_value) || '.' AS detail,
                   round(max_z, 3) AS score, outliers || ' outliers (robust z >= 3.5)' AS stat, n AS sample, least(3.0, max_z) / 3.5 AS effect,
                   CAST(NULL AS DOUBLE) AS p, least(1.0, outliers / greatest(n * 0.1, 1)) AS stability
            FROM ({_ANOMALY}) WHERE outliers > 0""",
        2,
    ),
)
def i5(spark, sf):
    return _findings(segments.anomaly_insights(_spiky(spark, sf), ["amount", "value"]))


_DIMS, _MEASURES = ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "swing"]
_SEGMENTS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, '{m}' AS measure, {d} AS segment, {m} AS v FROM {_LINES}" for d in _DIMS for m in _MEASURES
)
_ANOVA = f"""
  WITH rows AS ({_SEGMENTS}), g AS (SELECT dimension, measure, segment, count(*) AS n, avg(v) AS m, sum(v) AS t FROM rows GROUP BY ALL),
  o AS (SELECT dimension, measure, avg(v) AS gm, var_pop(v) AS vp, count(*) AS n FROM rows GROUP BY ALL)
  SELECT g.dimension, g.measure, count(*) AS groups, any_value(o.n) AS total_n, sum(g.n * (g.m - gm) ** 2) AS ssb,
         any_value(vp * o.n) - sum(g.n * (g.m - gm) ** 2) AS ssw, max(m) - min(m) AS spread, sqrt(any_value(vp)) AS sd,
         arg_min(segment, (-m, segment)) AS top_segment, arg_max(segment, (-m, segment)) AS bottom_segment
  FROM g JOIN o ON o.dimension = g.dimension AND o.measure = g.measure GROUP BY ALL"""


@query(
    "I7_anova",
    f"""SELECT dimension, measure, CAST(groups AS BIGINT) AS groups, CAST(total_n AS BIGINT) AS total_n, round(f, 4) AS f_stat,
               round(eta, 8) AS eta_squared, round({f_upper_sql('f', 'd1', 'd2')}, 6) AS p
        FROM (SELECT *, (ssb / (groups - 1)) / (ssw / (total_n - groups)) AS f, ssb / (ssb + ssw) AS eta,
                     groups - 1 AS d1, total_n - groups AS d2 FROM ({_ANOVA}))""",
)
def i7(spark, sf):
    stats = segment_stats(_lines(spark, sf), _DIMS, _MEASURES, segments.SEGMENT_VALUES)
    return with_f_p_value(anova(stats, segments.PAIR)).select(
        "dimension", "measure", "groups", "total_n", F.round("f_stat", 4).alias("f_stat"),
        F.round("eta_squared", 8).alias("eta_squared"), F.round("p", 6).alias("p"),
    )


@query(
    "I6_segment_drivers",
    scored_sql(
        f"""SELECT 'segment_driver' AS kind, dimension || ' strongly separates ' || measure AS title,
                   'On average ' || top_segment || ' is ' || format('{{:,.2f}}', spread) || ' above ' || bottom_segment || '.' AS detail,
                   round(abs(spread), 3) AS score, top_segment || ' vs ' || bottom_segment AS stat, total_n AS sample,
                   greatest(ssb / (ssb + ssw), spread / sd / 3) AS effect,
                   {f_upper_sql('((ssb / (groups - 1)) / (ssw / (total_n - groups)))', '(groups - 1)', '(total_n - groups)')} AS p, NULL AS stability
            FROM ({_ANOVA}) WHERE spread <> 0 AND spread / sd >= 0.35""",
        3,
    ),
)
def i6(spark, sf):
    return _findings(segments.segment_driver_insights(_lines(spark, sf), _DIMS, _MEASURES))


_SHARES = f"""
  WITH g AS (SELECT dimension, measure, segment, sum(v) AS t, count(*) AS n FROM ({_SEGMENTS}) GROUP BY ALL),
  s AS (SELECT *, t / sum(t) OVER (PARTITION BY dimension, measure) AS share FROM g)
  SELECT dimension, measure, sum(n) AS rows, arg_min(segment, (-share, segment)) AS top_segment, max(share) * 100 AS top_share, sum(share * share) AS hhi
  FROM s GROUP BY ALL"""


@query(
    "I8_contributions",
    scored_sql(
        f"""SELECT 'contribution' AS kind, top_segment || ' dominates contribution to ' || measure AS title,
                   'Of all ' || measure || ', ' || printf('%.2f', top_share) || '% comes from ' || top_segment || '.' AS detail,
                   round(top_share, 3) AS score, printf('%.2f', top_share) || '% share' AS stat, rows AS sample,
                   greatest(hhi, top_share / 100) AS effect, CAST(NULL AS DOUBLE) AS p, least(1.0, top_share / 60) AS stability
            FROM ({_SHARES}) WHERE top_share >= 35""",
        2,
    ),
)
def i8(spark, sf):
    return _findings(segments.contribution_insights(_lines(spark, sf), _DIMS, _MEASURES))


# --- I9-I12 -------------------------------------------------------------------------------------

_MONTHS = """(SELECT m, month(m) AS moy, t, n, row_number() OVER (ORDER BY m) - 1 AS x FROM
                (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1))"""


@query(
    "I9_month_totals",
    f"SELECT 'o_totalprice' AS measure, m AS month, round(t, 2) AS total, CAST(n AS BIGINT) AS n FROM {_MONTHS}",
)
def i9_months(spark, sf):
    totals = month_totals(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"])
    return totals.select("measure", "month", F.round("total", 2).alias("total"), "n")


_SEASON = f"""
  WITH p AS (SELECT moy, count(*) AS n, avg(t) AS mean, var_pop(t) * count(*) AS m2, sum(n) AS rows FROM {_MONTHS} GROUP BY moy),
  s AS (SELECT sum(n) AS months, max(mean) - min(mean) AS spread, abs(avg(mean)) AS level, arg_max(moy, mean) AS peak, arg_min(moy, mean) AS trough FROM p),
  v AS (SELECT sum(n * mean) / sum(n) AS gm, sum(n) AS total_n, count(*) AS groups, sum(m2) AS ssw FROM p WHERE n >= 2),
  b AS (SELECT sum(n * (mean - gm) ** 2) AS ssb FROM p, v WHERE n >= 2)
  SELECT *, spread / level AS strength, ssb / (ssb + ssw) AS eta FROM s, v, b"""


@query(
    "I9_seasonality",
    scored_sql(
        f"""SELECT 'seasonality' AS kind, 'o_totalprice shows a repeating month pattern' AS title,
                   'Over the years the totals of month ' || peak || ' are the highest and those of month ' || trough || ' the lowest.' AS detail,
                   round(spread, 3) AS score, 'month ' || peak || ' vs month ' || trough AS stat, months AS sample, greatest(eta, strength) AS effect,
                   {f_upper_sql('((ssb / (groups - 1)) / (ssw / (total_n - groups)))', '(groups - 1)', '(total_n - groups)')} AS p,
                   least(1.0, strength) AS stability
            FROM ({_SEASON}) WHERE strength >= 0.15""",
        1,
    ),
)
def i9(spark, sf):
    return _findings(series.seasonality_insights(table(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"]))


_FIT = f"""(SELECT regr_slope(t, x) AS s, regr_intercept(t, x) AS i, corr(t, x) AS r, count(*) AS months, arg_max(t, x) AS latest FROM {_MONTHS})"""


@query(
    "I10_forecast_values",
    f"""SELECT 'o_totalprice' AS measure, CAST(k AS BIGINT) AS step, round(i + s * (months + k - 1), 2) AS value
        FROM {_FIT}, (VALUES (1), (2), (3)) h(k) WHERE k <= least(3, greatest(1, months // 6))""",
)
def i10_values(spark, sf):
    months = month_totals(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"])
    return series.forecast_values(months).withColumn("value", F.round("value", 2))


@query(
    "I10_forecast",
    scored_sql(
        f"""SELECT 'forecast' AS kind, 'o_totalprice is projected to ' || CASE WHEN nx >= latest THEN 'grow' ELSE 'decline' END || ' next period' AS title,
                   'The line through the months reaches ' || format('{{:,.2f}}', nx) || ' after ' || format('{{:,.2f}}', latest) || ' in the last one.' AS detail,
                   round(abs(d) * 100, 3) AS score, 'next period ' || format('{{:,.2f}}', nx) || ' (' || printf('%+.1f', d * 100) || '%)' AS stat,
                   months AS sample, greatest(abs(d), abs(r)) AS effect, {t_two_sided_sql('r', 'months')} AS p, NULL AS stability
            FROM (SELECT *, i + s * months AS nx, (i + s * months - latest) / abs(latest) AS d FROM {_FIT}) WHERE abs(d) >= 0.05 OR abs(r) >= 0.35""",
        1,
    ),
)
def i10(spark, sf):
    return _findings(series.forecast_insights(table(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"]))


_SPLIT = f"""
  WITH w AS (SELECT *, avg(t) OVER (ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS tr FROM {_MONTHS}),
  p AS (SELECT moy, avg(t - tr) AS res FROM w GROUP BY moy)
  SELECT count(*) AS months, arg_max(tr, m) - arg_min(tr, m) AS change, abs(avg(t)) AS base, (SELECT max(res) - min(res) FROM p) AS swing FROM w"""


@query(
    "I11_decomposition",
    scored_sql(
        f"""SELECT 'decomposition' AS kind, 'o_totalprice can be split into trend and recurring pattern' AS title,
                   'Smoothed, it changed by ' || format('{{:,.2f}}', change) || '; around that, the months of the year swing by ' || format('{{:,.2f}}', swing) || '.' AS detail,
                   round(greatest(abs(change), abs(swing)), 3) AS score,
                   'trend delta ' || format('{{:,.2f}}', change) || ' / seasonal range ' || format('{{:,.2f}}', swing) AS stat, months AS sample,
                   greatest(abs(change) / base, swing / base) AS effect, CAST(NULL AS DOUBLE) AS p, least(1.0, swing / base) AS stability
            FROM ({_SPLIT}) WHERE abs(change) / base >= 0.08 OR swing / base >= 0.1""",
        1,
    ),
)
def i11(spark, sf):
    return _findings(series.decomposition_insights(table(spark, sf, "orders"), ["o_orderdate"], ["o_totalprice"]))


_VARIANCE = """
  WITH t AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 2),
  b AS (SELECT max(m) AS l, min(m) AS p, arg_max(t, m) - arg_min(t, m) AS d, abs(arg_min(t, m)) AS base FROM t),
  r AS (SELECT 'o_orderpriority' AS dimension, o_orderpriority AS segment, o_totalprice AS v, date_trunc('month', o_orderdate) AS m FROM orders
        UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice, date_trunc('month', o_orderdate) FROM orders),
  g AS (SELECT dimension, segment, sum(CASE WHEN m = l THEN v ELSE -v END) AS delta, count(*) AS k FROM r, b WHERE m IN (l, p) GROUP BY ALL),
  x AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(delta) DESC, segment) AS rn FROM g)
  SELECT dimension, segment, delta, k, d, base, strftime(l, '%Y-%m') AS l, strftime(p, '%Y-%m') AS p, abs(delta / d * 100) AS share FROM x, b WHERE rn = 1"""


@query(
    "I12_variance",
    scored_sql(
        f"""SELECT 'variance_explanation' AS kind, dimension || ' explains the latest change in o_totalprice' AS title,
                   'In ' || segment || ' it moved by ' || format('{{:,.2f}}', delta) || ', ' || printf('%.1f', share) || '% of the net change.' AS detail,
                   round(abs(delta), 3) AS score, l || ' vs ' || p AS stat, k AS sample, greatest(share / 100, abs(d) / base) AS effect,
                   CAST(NULL AS DOUBLE) AS p, least(1.0, share / 100) AS stability
            FROM (SELECT * FROM ({_VARIANCE})) WHERE share >= 20""",
        2,
    ),
)
def i12(spark, sf):
    found = series.variance_insights(
        table(spark, sf, "orders"), ["o_orderdate"], ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]
    )
    return _findings(found)


# --- I13-I15 ------------------------------------------------------------------------------------

_STAGES = ["view", "signup", "purchase"]


def _wide(spark, sf):
    """Events as one column per stage, so that stages are measures."""
    return table(spark, sf, "events").select(
        *[(F.col("event_type") == s).cast("int").alias(f"{s}_events") for s in _STAGES]
    )


def _funnel_sql(steps: str, stages: list[str], label: str) -> str:
    return scored_sql(
        f"""SELECT 'funnel' AS kind, 'Largest funnel friction appears between ' || a || ' and ' || b AS title,
                   'Of what enters this step ' || printf('%.2f', conv) || '% goes on; ' || format('{{:,.2f}}', d) || ' is lost.' AS detail,
                   round(100 - conv, 3) AS score, printf('%.2f', conv) || '% conversion' AS stat, vol AS sample,
                   greatest(0.0, (100 - conv) / 100) AS effect, CAST(NULL AS DOUBLE) AS p, least(1.0, vol / 500.0) AS stability
            FROM (SELECT * FROM ({steps}) ORDER BY conv, k LIMIT 1)""",
        1,
    )


_WIDE_STEPS = """
  WITH t AS (SELECT CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS v, CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS s,
                    CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS p FROM events)
  SELECT 0 AS k, 'view_events' AS a, 'signup_events' AS b, s / v * 100 AS conv, v - s AS d, CAST(v + s + p AS BIGINT) AS vol FROM t
  UNION ALL SELECT 1, 'signup_events', 'purchase_events', p / s * 100, s - p, CAST(v + s + p AS BIGINT) FROM t"""


@query("I13_funnel", _funnel_sql(_WIDE_STEPS, _STAGES, "events"))
def i13(spark, sf):
    return _findings(journeys.funnel_insights(_wide(spark, sf), [f"{s}_events" for s in _STAGES]))


@query(
    "I13_event_funnel",
    """WITH u AS (SELECT event_type AS stage, count(DISTINCT user_id) AS n FROM events GROUP BY 1)
       SELECT 0 AS position, 'view' AS from_stage, 'signup' AS to_stage, round(b.n * 100.0 / a.n, 6) AS conversion, CAST(a.n - b.n AS DOUBLE) AS "drop"
       FROM u a, u b WHERE a.stage = 'view' AND b.stage = 'signup'
       UNION ALL SELECT 1, 'signup', 'purchase', round(b.n * 100.0 / a.n, 6), CAST(a.n - b.n AS DOUBLE) FROM u a, u b WHERE a.stage = 'signup' AND b.stage = 'purchase'""",
)
def i13_events(spark, sf):
    totals = journeys.event_stage_totals(table(spark, sf, "events"), "user_id", "event_type", _STAGES)
    return journeys.funnel_steps(totals).withColumn("conversion", F.round("conversion", 6))


_COHORTS = """
  WITH a AS (SELECT o_custkey AS id, date_trunc('month', o_orderdate) AS m FROM orders), f AS (SELECT id, min(m) AS c, count(*) AS n FROM a GROUP BY id)
  SELECT c AS cohort, count(*) AS size, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.id = f.id AND a.m > f.c)) AS repeats, sum(n) AS rows FROM f GROUP BY c"""


@query(
    "I14_cohort_table",
    f"SELECT cohort, CAST(size AS BIGINT) AS size, CAST(repeats AS BIGINT) AS repeats, CAST(rows AS BIGINT) AS rows FROM ({_COHORTS})",
)
def i14_table(spark, sf):
    return journeys.cohort_table(table(spark, sf, "orders"), "o_orderdate", "o_custkey")


@query(
    "I14_retention",
    scored_sql(
        f"""SELECT 'retention_cohort' AS kind, strftime(cohort, '%Y-%m') || ' cohort has the strongest repeat activity' AS title,
                   'Of those first seen in that month, ' || printf('%.2f', rate) || '% come back in a later one.' AS detail, round(rate, 3) AS score,
                   printf('%.2f', rate) || '% repeat rate' AS stat, size AS sample, rate / 100 AS effect, CAST(NULL AS DOUBLE) AS p,
                   least(1.0, rate / 100) AS stability
            FROM (SELECT *, repeats * 100.0 / size AS rate FROM ({_COHORTS}) WHERE repeats > 0 ORDER BY rate DESC, cohort LIMIT 1)""",
        1,
    ),
)
def i14(spark, sf):
    return _findings(journeys.retention_insights(table(spark, sf, "orders"), ["o_orderdate"], ["o_custkey"]))


@query("I15_model_driver")
def i15(spark, sf):
    return drivers.model_driver_insights(_lines(spark, sf), ["l_returnflag", "l_linestatus"], ["swing", "net", "l_quantity"])


_CHOICES = {"swing": ["l_returnflag", "l_linestatus", "net", "l_quantity"], "net": ["l_returnflag", "l_linestatus", "swing", "l_quantity"]}
_CHOICE_SHARES = " UNION ALL ".join(
    f"SELECT '{t}' AS measure, '{c}' AS driver, "
    + (f"var_pop(m) / max(v) AS share FROM (SELECT avg({t}) OVER (PARTITION BY {c}) AS m, var_pop({t}) OVER () AS v FROM {_LINES})" if c in ("l_returnflag", "l_linestatus")
       else f"corr({t}, {c}) * corr({t}, {c}) AS share FROM {_LINES}")
    for t, columns in _CHOICES.items() for c in columns
)


@query(
    "I15_driver_choice",
    f"""WITH s AS ({_CHOICE_SHARES})
        SELECT measure, driver, (SELECT count(*) FROM lineitem) AS rows, share <= 1 AS explains_more
        FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY share DESC) AS place FROM s) WHERE place = 1""",
)
def i15_choice(spark, sf):
    """The forest's first driver is the column that explains most on its own, and the forest explains at least as much."""
    rows = _lines(spark, sf)
    models = drivers.driver_models(rows, list(_CHOICES), ["l_returnflag", "l_linestatus"], ["swing", "net", "l_quantity"])
    found = []
    for target, (importance, r2, n) in models.items():
        top = max(importance, key=importance.get)
        if top.startswith("l_r") or top.startswith("l_l"):
            spread = rows.groupBy(top).agg(F.count(target).alias("n"), F.avg(target).alias("m"))
            grand = rows.agg(F.var_pop(target).alias("v"), F.avg(target).alias("g")).first()
            share = spread.agg(F.sum(F.col("n") * (F.col("m") - grand["g"]) ** 2) / F.sum("n")).first()[0] / grand["v"]
        else:
            share = rows.agg(F.corr(target, top)).first()[0] ** 2
        found.append((target, top, n, share - 0.01 <= r2 <= 1))
    return spark.createDataFrame(found, "measure string, driver string, rows long, explains_more boolean")


# --- I16-I19 ------------------------------------------------------------------------------------


@query(
    "I16_scores",
    f"""SELECT event_id, c AS confidence_score, CASE WHEN c >= 80 THEN 'high' WHEN c >= 60 THEN 'medium' ELSE 'low' END AS confidence_label,
               CAST(printf('%.3f', ln(1 + value) * greatest(c / 20, 1.0)) AS DOUBLE) AS priority_score
        FROM (SELECT event_id, value, {confidence_sql('event_id % 100', 'value / 25', "CASE WHEN event_id % 2 = 0 THEN (event_id % 30) / 100.0 END", "CASE WHEN event_id % 3 <> 0 THEN (event_id % 13) / 10.0 END")} AS c FROM events)""",
)
def i16(spark, sf):
    """The score formulas over every combination of evidence, one finding per event."""
    key = F.col("event_id")
    text = F.lit("").alias
    raw = table(spark, sf, "events").select(
        key.cast("string").alias("kind"), text("title"), text("detail"), F.col("value").alias("score"), text("stat"),
        text("chart_type"), F.array().cast("array<string>").alias("chart_columns"), (key % 100).alias("sample_size"),
        (F.col("value") / 25).alias("effect"), F.when(key % 2 == 0, (key % 30) / 100).alias("p"),
        F.when(key % 3 != 0, (key % 13) / 10).alias("stability"), F.array().cast("array<string>").alias("why"),
    )
    return enrich(raw).select(F.col("kind").cast("long").alias("event_id"), "confidence_score", "confidence_label", "priority_score")


# The ranked findings below join detectors whose own statements stand above.
_RANKED = ["I1_correlation_insights", "I2_distribution_insights", "I6_segment_drivers", "I8_contributions",
           "I9_seasonality", "I10_forecast", "I11_decomposition", "I12_variance"]
_RANKED_SQL = " UNION ALL ".join(f"SELECT * FROM ({ORACLES[name]})" for name in _RANKED)
_RANK_ORDER = "priority_score DESC, confidence_score DESC, score DESC, kind, title"


def _ranked(spark, sf):
    rows, orders = _lines(spark, sf), table(spark, sf, "orders")
    dates, dims, price = ["o_orderdate"], ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]
    parts = [
        foundational.correlation_insights(rows),
        foundational.distribution_insights(rows),
        segments.segment_driver_insights(rows, _DIMS, _MEASURES),
        segments.contribution_insights(rows, _DIMS, _MEASURES),
        series.seasonality_insights(orders, dates, price),
        series.forecast_insights(orders, dates, price),
        series.decomposition_insights(orders, dates, price),
        series.variance_insights(orders, dates, dims, price),
    ]
    return summary.ranked(summary.union(parts), summary.KEY_INSIGHTS)


@query("I17_ranked_findings", f"SELECT * FROM ({_RANKED_SQL}) ORDER BY {_RANK_ORDER} LIMIT 8")
def i17_ranked(spark, sf):
    return _findings(_ranked(spark, sf))


@query(
    "I19_takeaways",
    f"""WITH top AS (SELECT row_number() OVER (ORDER BY {_RANK_ORDER}) AS place, * FROM ({_RANKED_SQL}))
        SELECT CAST(0 AS INTEGER) AS place, 'Data quality note: No quality alert - Repeats, gaps and far values are all below their limits.' AS text
        FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS k FROM orders) WHERE n = k
        UNION ALL SELECT CAST(place AS INTEGER), title || ' (' || confidence_label || ' confidence): ' || detail FROM top WHERE place <= 3""",
)
def i19(spark, sf):
    return summary.takeaways(_ranked(spark, sf), profile.quality_alerts(table(spark, sf, "orders")))


def _roles():
    return summary.Roles(["swing", "l_quantity"], ["l_returnflag", "l_linestatus"], ["l_shipdate"], [], frozenset())


@query("I17_key_insights")
def i17(spark, sf):
    rows = _lines(spark, sf)
    return summary.key_insights(foundational.foundational(rows), summary.advanced_insights(rows, _roles()))


@query("I17_dataset_summary")
def i17_summary(spark, sf):
    """Key insights of the orders table as the summary finds them from the inferred roles."""
    return summary.analyse(table(spark, sf, "orders")).key_insights


@query(
    "I18_recommended_charts",
    f"""WITH found AS (SELECT kind, title, priority_score, score FROM ({ORACLES["I1_correlation_insights"]})
                       UNION ALL SELECT kind, title, priority_score, score FROM ({ORACLES["I3_concentration_insights"]})
                       UNION ALL SELECT kind, title, priority_score, score FROM ({ORACLES["I2_distribution_insights"]})),
        charts AS (SELECT row_number() OVER (ORDER BY list_position(['correlation', 'categorical', 'distribution'], kind), priority_score DESC, score DESC, title) AS place,
                          CASE kind WHEN 'correlation' THEN 'scatter' WHEN 'categorical' THEN 'bar' ELSE 'histogram' END AS chart_type,
                          CASE kind WHEN 'correlation' THEN replace(replace(title, ' move together', ''), ' and ', ',')
                                    WHEN 'categorical' THEN string_split(title, ' is concentrated')[1] ELSE string_split(title, ' has a ')[1] END AS chart_columns FROM found
                   UNION ALL SELECT 0, 'kpi', 'l_quantity' UNION ALL SELECT 1000, 'heatmap', 'l_returnflag,l_linestatus')
        SELECT CAST(row_number() OVER (ORDER BY place) AS BIGINT) AS position, chart_type, chart_columns FROM charts ORDER BY place LIMIT 6""",
)
def i18(spark, sf):
    numbers = _lines(spark, sf).select("l_quantity", "l_extendedprice", "net", "swing")
    base = summary.union(
        [
            foundational.correlation_insights(numbers),
            foundational.concentration_insights(_categories(spark, sf)),
            foundational.distribution_insights(numbers),
        ]
    )
    charts = summary.recommended_charts(_lines(spark, sf).drop("l_shipdate"), base)
    return charts.withColumn("chart_columns", F.array_join("chart_columns", ","))
