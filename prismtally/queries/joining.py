"""Joins, key candidates and relationship suggestions (J1-J7; the name comparison of J7 is part of J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismtally.operators import joins, relationships
from prismtally.plans.replay import DatasetRecord, join_datasets
from prismtally.queries.registry import query, table


def _left(spark, sf):
    """Orders whose key is missing now and then."""
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("custkey"), "o_totalprice"
    )


def _right(spark, sf):
    return table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 500 != 3, F.col("c_custkey")).alias("custkey"), "c_name", "c_mktsegment"
    )


_SIDES = """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS custkey, o_totalprice FROM orders),
                 r AS (SELECT CASE WHEN c_custkey % 500 <> 3 THEN c_custkey END AS custkey, c_name, c_mktsegment FROM customer)
            SELECT o_orderkey, l.custkey AS custkey, o_totalprice, r.custkey AS custkey_related, c_name, c_mktsegment
            FROM l {how} JOIN r ON l.custkey = r.custkey"""


@query("J1_join_left", _SIDES.format(how="LEFT"))
def j1_left(spark, sf):
    return joins.join_on_keys(_left(spark, sf), _right(spark, sf), "custkey", "custkey", "left")


@query("J1_join_inner", _SIDES.format(how="INNER"))
def j1_inner(spark, sf):
    return joins.join_on_keys(_left(spark, sf), _right(spark, sf), "custkey", "custkey", "inner")


_FULL = """WITH l AS (SELECT o_orderkey, o_custkey + 100 AS custkey FROM orders),
                r AS (SELECT CASE WHEN c_custkey % 500 <> 3 THEN c_custkey END AS custkey, c_name FROM customer)
           SELECT o_orderkey, l.custkey AS custkey, r.custkey AS custkey_related, c_name
           FROM l FULL JOIN r ON l.custkey = r.custkey"""


@query("J1_join_outer", _FULL)
def j1_outer(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("custkey"))
    return joins.join_on_keys(left, _right(spark, sf).select("custkey", "c_name"), "custkey", "custkey", "outer")


@query(
    "J2_normalised_keys",
    """SELECT o_orderkey, o_custkey || ' ' AS code, c_custkey, c_mktsegment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def j2(spark, sf):
    """Padded number text on one side, numbers on the other."""
    left = table(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(" ")).alias("code"))
    right = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return joins.join_on_keys(left, right, "code", "c_custkey", "inner")


@query(
    "J2_odd_keys",
    """WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_orderkey % 40 = 1 THEN 'odd ' || o_custkey
                              ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS code FROM orders),
            r AS (SELECT CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 20 = 1 THEN 'odd ' || c_custkey || ' '
                              ELSE ' ' || c_custkey END AS ref, c_mktsegment FROM customer),
            k AS (SELECT *, coalesce(CAST(TRY_CAST(code AS DOUBLE) AS VARCHAR), 't' || trim(code)) AS lk FROM l),
            m AS (SELECT *, coalesce(CAST(TRY_CAST(trim(ref) AS DOUBLE) AS VARCHAR), 't' || trim(ref)) AS rk FROM r)
       SELECT o_orderkey, code, ref, c_mktsegment FROM k LEFT JOIN m ON lk = rk""",
)
def j2_odd(spark, sf):
    """Number texts with missing keys and keys that are no numbers on both sides: a missing key matches nothing."""
    order, customer = F.col("o_orderkey"), F.col("c_custkey")
    left = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(order % 40 == 0, None).when(order % 40 == 1, F.concat(F.lit("odd "), "o_custkey")).otherwise(F.concat("o_custkey", F.lit(".0"))).alias("code"),
    )
    right = table(spark, sf, "customer").select(
        F.when(customer % 20 == 0, None).when(customer % 20 == 1, F.concat(F.lit("odd "), "c_custkey", F.lit(" "))).otherwise(F.concat(F.lit(" "), "c_custkey")).alias("ref"),
        "c_mktsegment",
    )
    return joins.join_on_keys(left, right, "code", "ref", "left")


@query(
    "J2_text_keys",
    """SELECT c_custkey, ' ' || c_name || '  ' AS name_key, upper(c_mktsegment) AS segment
       FROM customer""",
)
def j2_text(spark, sf):
    customers = table(spark, sf, "customer")
    left = customers.select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("name_key"))
    right = customers.select(F.concat("c_name", F.lit("\t")).alias("other"), F.upper("c_mktsegment").alias("segment"))
    return joins.join_on_keys(left, right, "name_key", "other", "inner").drop("other")


@query("J3_join_datasets", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
def j3(spark, sf):
    left = DatasetRecord("nation", "upload", f"{sf}/nation.parquet")
    right = DatasetRecord("region", "upload", f"{sf}/region.parquet")
    return join_datasets(spark, left, right, "n_regionkey", "r_regionkey", "inner")


def _key_sql(table_name: str, columns: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS p, count(DISTINCT trim(CAST({c} AS VARCHAR))) AS u, count(*) AS n FROM {table_name}"
        for c in columns
    )
    hint = " OR ".join(f"contains(lower(\"column\"), '{h}')" for h in ("id", "key", "code", "number", "no"))
    return f"""
      WITH s AS ({rows}), q AS (SELECT "column", u, u / greatest(p, 1) AS ur, p / greatest(n, 1) AS pr,
                                       CASE WHEN {hint} THEN 0.2 ELSE 0.0 END AS b FROM s)
      SELECT "column", CAST(printf('%.3f', CAST(ur AS DOUBLE)) AS DOUBLE) AS unique_ratio, CAST(printf('%.3f', CAST(pr AS DOUBLE)) AS DOUBLE) AS non_null_ratio,
             CAST(printf('%.3f', CAST(least(1.0, ur * 0.65 + pr * 0.25 + b) AS DOUBLE)) AS DOUBLE) AS score,
             CASE WHEN ur >= 0.95 THEN 'primary_key' ELSE 'foreign_key_candidate' END AS role_hint,
             CAST(u AS BIGINT) AS unique_count
      FROM q WHERE pr >= 0.7 AND ur >= 0.55 ORDER BY score DESC, "column" LIMIT 8"""


@query("J4_key_candidates_customer", _key_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def j4(spark, sf):
    return relationships.key_candidates(table(spark, sf, "customer")).drop("dataset_rows")


@query(
    "J4_key_candidates_lineitem",
    _key_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
)
def j4_lineitem(spark, sf):
    return relationships.key_candidates(table(spark, sf, "lineitem")).drop("dataset_rows")


@query(
    "J5_value_overlap",
    """WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT c_custkey AS v FROM customer),
            c AS (SELECT DISTINCT s_suppkey AS v FROM supplier),
            ab AS (SELECT count(*) AS k FROM a JOIN b USING (v)), ac AS (SELECT count(*) AS k FROM a JOIN c USING (v)),
            bc AS (SELECT count(*) AS k FROM b JOIN c USING (v)),
            n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc)
       SELECT 0 AS i, 1 AS j, CAST(k AS BIGINT) AS shared, CAST(na AS BIGINT) AS left_unique,
              CAST(nb AS BIGINT) AS right_unique, round(k / least(na, nb), 6) AS overlap FROM ab, n
       UNION ALL SELECT 0, 2, k, na, nc, round(k / least(na, nc), 6) FROM ac, n
       UNION ALL SELECT 1, 2, k, nb, nc, round(k / least(nb, nc), 6) FROM bc, n""",
)
def j5(spark, sf):
    found = relationships.overlaps(
        [(table(spark, sf, "orders"), "o_custkey"), (table(spark, sf, "customer"), "c_custkey"), (table(spark, sf, "supplier"), "s_suppkey")]
    )
    return found.withColumn("overlap", F.round("overlap", 6))


_J6 = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}


def _expected_ratio(a: str, b: str) -> float:
    """Twice the letters in common blocks over all letters: the longest block first, then both sides of it."""
    a, b = a.replace("_", ""), b.replace("_", "")

    def common(x: str, y: str) -> int:
        spots = [(k, -i, -j) for i in range(len(x)) for j in range(len(y)) for k in range(1, min(len(x) - i, len(y) - j) + 1) if x[i : i + k] == y[j : j + k]]
        if not spots:
            return 0
        k, i, j = max(spots)
        return k + common(x[:-i], y[:-j]) + common(x[k - i :], y[k - j :])

    return 2 * common(a, b) / (len(a) + len(b))


def _j6_sql() -> str:
    keys = [(d, c) for d, cs in _J6.items() for c in cs]
    values = " UNION ALL ".join(f"SELECT DISTINCT {i} AS id, trim(CAST({c} AS VARCHAR)) AS v FROM {d} WHERE {c} IS NOT NULL" for i, (d, c) in enumerate(keys))
    stats = " UNION ALL ".join(
        f"SELECT {i} AS id, '{d}' AS d, '{c}' AS c, count(DISTINCT {c}) / greatest(count({c}), 1) AS ur, count({c}) / greatest(count(*), 1) AS pr, count(*) AS n FROM {d}"
        for i, (d, c) in enumerate(keys)
    )
    names = ", ".join(
        f"({i}, {j}, {_expected_ratio(a[1], b[1])!r})" for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and a[0] != b[0]
    )
    hint = " OR ".join(f"contains(c, '{h}')" for h in ("id", "key", "code", "number", "no"))
    return f"""
      WITH stats AS ({stats}),
      gated AS (SELECT *, CAST(printf('%.3f', CAST(least(1.0, ur * 0.65 + pr * 0.25 + CASE WHEN {hint} THEN 0.2 ELSE 0 END) AS DOUBLE)) AS DOUBLE) AS s
                FROM stats WHERE pr >= 0.7 AND ur >= 0.55),
      keyed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s DESC, c) AS place FROM gated) WHERE place <= 8),
      every AS ({values}), vals AS (SELECT * FROM every WHERE id IN (SELECT id FROM keyed)),
      sizes AS (SELECT id, count(*) AS k FROM vals GROUP BY id),
      shared AS (SELECT x.id AS i, y.id AS j, count(*) AS k FROM vals x JOIN vals y ON x.v = y.v AND x.id < y.id GROUP BY ALL),
      names(i, j, sim) AS (SELECT i, j, CAST(s AS DOUBLE) FROM (VALUES {names}) v(i, j, s)),
      scored AS (SELECT a.d AS ad, a.c AS ac, a.place AS ap, a.n AS an, b.d AS bd, b.c AS bc, b.n AS bn, sim,
                        coalesce(shared.k / least(sa.k, sb.k), 0.0) AS ov, least(a.s, b.s) AS ks
                 FROM names JOIN keyed a ON a.id = names.i JOIN keyed b ON b.id = names.j
                 JOIN sizes sa ON sa.id = names.i JOIN sizes sb ON sb.id = names.j
                 LEFT JOIN shared ON shared.i = names.i AND shared.j = names.j)
      SELECT ad AS left_dataset, ac AS left_column, bd AS right_dataset, bc AS right_column,
             CAST(printf('%.3f', CAST(ov * 0.7 + sim * 0.2 + ks * 0.1 AS DOUBLE)) AS DOUBLE) AS confidence, CAST(printf('%.3f', CAST(ov AS DOUBLE)) AS DOUBLE) AS overlap_score,
             CAST(printf('%.3f', CAST(sim AS DOUBLE)) AS DOUBLE) AS name_similarity, CASE WHEN an >= bn THEN 'left' ELSE 'inner' END AS recommended_join
      FROM scored WHERE ov * 0.7 + sim * 0.2 + ks * 0.1 >= 0.35
      ORDER BY confidence DESC, left_dataset, left_column, right_dataset, right_column LIMIT 12"""


@query("J6_relationships", _j6_sql())
def j6(spark, sf):
    """Four whole tables; the gates decide which of their columns are compared."""
    return relationships.suggest_relationships({d: table(spark, sf, d) for d in _J6})
