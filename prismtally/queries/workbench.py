"""The SQL workbench (Q1-Q4) and one query per relational category (Q6-Q14)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismtally.operators.filters import clean_policies
from prismtally.plans.workbench import RefusedStatement, guard, run_query
from prismtally.queries.registry import query, table


def _workbench(name: str, source: str, spark_sql: str, oracle: str | None = None) -> None:
    """A workbench statement over one table; the oracle is the same text unless dialects differ."""

    @query(name, (oracle or spark_sql).replace("dataset", source))
    def run(spark, sf):
        return run_query(table(spark, sf, source), spark_sql).rows


_workbench(
    "Q1_grouped_sql",
    "orders",
    """SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS total, CAST(COUNT(*) AS BIGINT) AS n FROM dataset
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' GROUP BY 1 ORDER BY 2 DESC""",
)


@query(
    "Q2_limited_preview",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS row_count FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2000",
)
def q2(spark, sf):
    """A limit of 5000 is clamped to 2000; the count is that of the whole result."""
    sql = "SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_totalprice DESC, o_orderkey"
    result = run_query(table(spark, sf, "orders"), sql, limit=5000)
    return result.preview.withColumn("row_count", F.lit(result.count()).cast("long"))


_REFUSED = {
    "DROP TABLE dataset": "not_a_query",
    "SELECT 'delete' FROM dataset": "refused_word",
    "SELECT 1; SELECT 2 FROM dataset": "second_statement",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM dataset": "reflection",
    "SELECT * FROM parquet.`{sf}/customer.parquet`": "other_relation",
    "WITH x AS (SELECT 1) SELECT * FROM dataset WHERE o_orderkey IN (SELECT c_custkey FROM parquet.`{sf}/customer.parquet`)": "other_relation",
}


@query(
    "Q3_guard",
    f"""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, '{" ".join(_REFUSED.values())}' AS refused FROM orders GROUP BY 1""",
)
def q3(spark, sf):
    """The statement that passes, beside the reasons why others do not."""
    orders, reasons = table(spark, sf, "orders"), []
    for sql in _REFUSED:
        try:
            run_query(orders, sql.replace("{sf}", sf))
        except RefusedStatement as refusal:
            reasons.append(refusal.reason)
    rows = run_query(orders, guard("SELECT o_orderstatus, COUNT(*) AS n FROM dataset GROUP BY 1;")).rows
    return rows.withColumn("refused", F.lit(" ".join(reasons)))


@query("Q4_policy_sql", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def q4(spark, sf):
    policies = clean_policies([{"user": "viewer", "column": "o_orderpriority", "allowed_values": ["1-URGENT", "2-HIGH"]}])
    sql = "SELECT o_orderstatus, ROUND(SUM(o_totalprice), 2) AS total FROM dataset GROUP BY 1"
    return run_query(table(spark, sf, "orders"), sql, policies=policies, user="viewer", owner="owner").rows


_workbench(
    "Q6_expressions",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net,
              CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 10 THEN 'medium' ELSE 'small' END AS size
       FROM dataset WHERE l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_discount BETWEEN 0.02 AND 0.06""",
)
_workbench(
    "Q7_aggregates_having",
    "lineitem",
    """SELECT l_suppkey, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS parts, ROUND(AVG(l_quantity), 6) AS quantity
       FROM dataset GROUP BY l_suppkey HAVING COUNT(*) > 10""",
)
_workbench(
    "Q8_rollup",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(l_quantity), 2) AS quantity, CAST(GROUPING(l_linestatus) AS INT) AS g
       FROM dataset GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
_workbench(
    "Q8_cube",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM dataset
       GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""",
)
_workbench(
    "Q8_grouping_sets",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice), 2) AS price FROM dataset
       GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""",
)
# Daily totals come first, so that a customer's window is bounded by the calendar.
_workbench(
    "Q9_windows",
    "orders",
    """SELECT * FROM (
         SELECT o_custkey, day, ROUND(total - LAG(total) OVER (PARTITION BY o_custkey ORDER BY day), 2) AS step,
                ROUND(SUM(total) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent,
                CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY ROUND(total, 2) DESC, day) AS BIGINT) AS place
         FROM (SELECT o_custkey, o_orderdate AS day, SUM(o_totalprice) AS total FROM dataset GROUP BY o_custkey, o_orderdate) days) ranked
       WHERE place <= 3""",
)
_workbench(
    "Q10_semi_join",
    "orders",
    """SELECT a.o_orderkey, a.o_custkey FROM dataset a
       WHERE EXISTS (SELECT 1 FROM dataset b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = '1-URGENT' AND b.o_orderstatus = 'P')""",
)
_workbench(
    "Q10_anti_join",
    "orders",
    """SELECT a.o_orderkey, a.o_custkey FROM dataset a
       WHERE NOT EXISTS (SELECT 1 FROM dataset b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = '1-URGENT' AND b.o_orderstatus = 'P')""",
)
_workbench(
    "Q10_non_equi_join",
    "orders",
    """SELECT a.o_orderkey, a.o_custkey, ROUND(a.o_totalprice, 2) AS price FROM dataset a
       JOIN (SELECT o_custkey, AVG(o_totalprice) AS usual FROM dataset GROUP BY o_custkey) b
         ON a.o_custkey = b.o_custkey AND a.o_totalprice > 1.5 * b.usual""",
)
_workbench(
    "Q10_self_join",
    "orders",
    """SELECT a.o_custkey, a.n AS urgent, b.n AS low FROM
         (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM dataset WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a
         FULL JOIN (SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM dataset WHERE o_orderpriority = '5-LOW' GROUP BY 1) b ON a.o_custkey = b.o_custkey""",
)
_workbench(
    "Q11_set_operations",
    "orders",
    """SELECT * FROM (SELECT o_custkey FROM dataset WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM dataset WHERE o_orderstatus = 'O') both_states
       EXCEPT SELECT o_custkey FROM dataset WHERE o_orderpriority = '1-URGENT'
       UNION ALL SELECT o_custkey FROM dataset WHERE o_totalprice > 450000""",
)
_workbench(
    "Q12_top_k",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM dataset ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
)
_workbench(
    "Q13_subqueries",
    "orders",
    """WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM dataset GROUP BY o_custkey)
       SELECT o_custkey, ROUND(total, 2) AS total FROM spend WHERE total > (SELECT AVG(total) FROM spend)""",
)
_workbench(
    "Q13_recursive",
    "orders",
    """WITH RECURSIVE years(y) AS (SELECT 1995 UNION ALL SELECT y + 1 FROM years WHERE y < 2001)
       SELECT CAST(y AS INT) AS y, CAST(COUNT(o_orderkey) AS BIGINT) AS n FROM years LEFT JOIN dataset ON YEAR(o_orderdate) = y GROUP BY y""",
)
_workbench(
    "Q14_scalar_functions",
    "events",
    """SELECT event_id, UPPER(SUBSTRING(event_type, 1, 3)) AS code, CAST(DATE_TRUNC('hour', ts) AS TIMESTAMP_NTZ) AS hour, ROUND(SQRT(value), 6) AS root,
              CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k, CAST(LENGTH(props) AS BIGINT) AS chars FROM dataset""",
    """SELECT event_id, upper(substring(event_type, 1, 3)) AS code, date_trunc('hour', ts) AS hour, round(sqrt(value), 6) AS root,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(length(props) AS BIGINT) AS chars FROM dataset""",
)
_workbench(
    "Q14_text_functions",
    "documents",
    """SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS chars, CAST(SIZE(SPLIT(text, ' ')) AS BIGINT) AS pieces, LOWER(SUBSTRING(text, 1, 20)) AS lead,
              CONCAT(lang, '/', source) AS origin, CAST(LOCATE('the', text) AS BIGINT) AS first_the FROM dataset""",
    """SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces, lower(substring(text, 1, 20)) AS lead,
              lang || '/' || source AS origin, CAST(strpos(text, 'the') AS BIGINT) AS first_the FROM dataset""",
)


@query(
    "Q9_dataframe_windows",
    """SELECT o_orderpriority, month, round(total, 2) AS total, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY round(total, 2) DESC) AS BIGINT) AS place,
              round(lead(total) OVER (PARTITION BY o_orderpriority ORDER BY month), 2) AS following
       FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL)""",
)
def q9(spark, sf):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    totals = table(spark, sf, "orders").groupBy("o_orderpriority", month).agg(F.sum("o_totalprice").alias("total"))
    group = Window.partitionBy("o_orderpriority")
    return totals.select(
        "o_orderpriority",
        "month",
        F.round("total", 2).alias("total"),
        F.rank().over(group.orderBy(F.desc(F.round("total", 2)))).cast("long").alias("place"),
        F.round(F.lead("total").over(group.orderBy("month")), 2).alias("following"),
    )
