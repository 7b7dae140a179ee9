"""Registered queries: one callable per operator, most with an independent SQL statement.

The SQL is written for another engine and never shares code with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments of the insight scores -----------------------------------------------------


def confidence_sql(sample: str, effect: str, p: str = "NULL", stability: str = "NULL") -> str:
    return (
        f"CAST(printf('%.1f', least(99.0, least(({sample}) / 80.0, 1.0) * 35 + least(abs({effect}), 2.0) / 2 * 35 + "
        f"CASE WHEN ({p}) IS NOT NULL THEN greatest(0.0, 1 - least({p}, 0.2) / 0.2) * 30 "
        f"WHEN ({stability}) IS NOT NULL THEN least(greatest({stability}, 0.0), 1.0) * 20 ELSE 0 END)) AS DOUBLE)"
    )


def scored_sql(rows: str, limit: int) -> str:
    """Scores and cuts raw findings: columns kind, title, detail, score, stat, sample, effect, p, stability."""
    return f"""
      WITH raw AS ({rows}),
      scored AS (SELECT *, {confidence_sql('sample', 'effect', 'p', 'stability')} AS confidence_score FROM raw)
      SELECT kind, title, detail, score, stat, CAST(sample AS BIGINT) AS sample_size,
             CAST(printf('%.4f', effect) AS DOUBLE) AS effect_size, CAST(printf('%.6f', p) AS DOUBLE) AS p_value, confidence_score,
             CASE WHEN confidence_score >= 80 THEN 'high' WHEN confidence_score >= 60 THEN 'medium' ELSE 'low' END
               AS confidence_label,
             CAST(printf('%.3f', ln(1 + abs(score)) * greatest(confidence_score / 20, 1.0)) AS DOUBLE) AS priority_score
      FROM scored ORDER BY priority_score DESC, score DESC, title LIMIT {limit}"""


FINDING_COLUMNS = [
    "kind", "title", "detail", "score", "stat", "sample_size", "effect_size", "p_value",
    "confidence_score", "confidence_label", "priority_score",
]


def t_two_sided_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by Simpson's rule over the t density (4000 steps)."""
    t = f"(abs({r}) * sqrt(({n} - 2) / greatest(1 - ({r}) * ({r}), 1e-300)))"
    nu = f"({n} - 2.0)"
    top = f"least({t}, 60.0)"
    density = (
        f"exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2) - 0.5 * ln({nu} * pi()) "
        f"- ({nu} + 1) / 2 * ln(1 + ({top} * k / 4000.0) * ({top} * k / 4000.0) / {nu}))"
    )
    weight = "(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return (
        f"greatest(0.0, 1 - 2 * {top} / 12000.0 * "
        f"list_sum(list_transform(range(0, 4001), lambda k: {weight} * {density})))"
    )


def f_upper_sql(f: str, d1: str, d2: str) -> str:
    """Upper tail of F by Simpson's rule over the density of its square root (8000 steps)."""
    top = f"sqrt(least({f}, 400.0))"
    s = f"({top} * greatest(k, 0.000001) / 8000.0)"
    log_density = (
        f"ln(2.0) + lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) "
        f"+ {d1} / 2.0 * ln({d1} / ({d2} * 1.0)) + ({d1} - 1) * ln({s}) "
        f"- ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {s} * {s} / {d2})"
    )
    weight = "(CASE WHEN k = 0 OR k = 8000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return (
        f"greatest(0.0, 1 - {top} / 24000.0 * "
        f"list_sum(list_transform(range(0, 8001), lambda k: {weight} * exp({log_density}))))"
    )
