"""Sample statistics from sufficient statistics, and t / F tail probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sample_skewness(population_skew: Column, n: Column) -> Column:
    """Bias-corrected skewness (needs 3 values; 0 for a constant column)."""
    n = n.cast("double")
    corrected = population_skew * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(F.isnan(population_skew) | population_skew.isNull(), F.lit(0.0)).otherwise(corrected))


def sample_kurtosis(population_kurtosis: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis (needs 4 values; 0 for a constant column)."""
    n = n.cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_kurtosis + 6)
    return F.when(
        n >= 4, F.when(F.isnan(population_kurtosis) | population_kurtosis.isNull(), F.lit(0.0)).otherwise(corrected)
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Continued fraction of the incomplete beta function, modified Lentz evaluation.
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def regularized_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b)


# Beyond this many degrees of freedom the limits (normal, chi-squared) are closer than the
# cancellation in the gamma functions allows.
LIMIT_DOF = 1e7


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the upper regularised incomplete gamma function, for moderate ``a``."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    # Continued fraction, evaluated forwards.
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def t_two_sided(t: float | None, dof: float | None) -> float | None:
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    if dof > LIMIT_DOF:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return regularized_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def f_upper(f: float | None, dof1: float | None, dof2: float | None) -> float | None:
    if f is None or dof1 is None or dof2 is None or dof1 <= 0 or dof2 <= 0 or math.isnan(f):
        return None
    if math.isinf(f):
        return 0.0
    if dof2 > LIMIT_DOF and dof1 < 1e5:
        return gamma_upper(dof1 / 2.0, dof1 * f / 2.0)
    return regularized_beta(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * f))


def _plain(value) -> float | None:
    return None if value is None or pd.isna(value) else float(value)


# Both run on aggregated rows only (one per column pair, dimension or series).
@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    def one(r_, n_):
        r_, n_ = _plain(r_), _plain(n_)
        if r_ is None or n_ is None or n_ < 3:
            return None
        return t_two_sided(math.inf if abs(r_) >= 1 else r_ * math.sqrt((n_ - 2) / (1 - r_ * r_)), n_ - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
    return pd.Series(
        [f_upper(_plain(a), _plain(b), _plain(c)) for a, b, c in zip(f, dof1, dof2)], dtype="float64"
    )


def anova_columns() -> list[Column]:
    """``f_stat, eta_squared, dof1, dof2`` from ``groups, total_n, ss_between, ss_within``."""
    dof1, dof2 = F.col("groups") - 1, F.col("total_n") - F.col("groups")
    enough = F.col("groups") >= 2
    f_stat = F.when(enough, F.try_divide(F.col("ss_between") / dof1, F.try_divide(F.col("ss_within"), dof2)))
    eta = F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))
    return [
        f_stat.alias("f_stat"),
        F.when(enough, F.coalesce(eta, F.lit(0.0))).otherwise(F.lit(0.0)).alias("eta_squared"),
        dof1.cast("double").alias("dof1"),
        dof2.cast("double").alias("dof2"),
    ]


def anova(groups: DataFrame, keys: list[str]) -> DataFrame:
    """One-way analysis of variance per ``keys`` from one row (n, mean, m2) per group.

    Groups of fewer than two values are left out. The grand mean comes from a first aggregate,
    so between-group deviations are summed around it and do not cancel. ``p_value`` and
    ``eta_squared`` follow; fewer than two usable groups give a null p and eta 0.
    """
    usable = groups.where(F.col("n") >= 2)
    grand = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    if keys:
        centred = usable.join(usable.groupBy(*keys).agg(grand), keys)
    else:
        centred = usable.withColumn("grand", usable.agg(grand).scalar())
    deviation = F.col("mean") - F.col("grand")
    sums = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("total_n"),
        F.sum(F.col("n") * deviation * deviation).alias("ss_between"),
        F.sum("m2").alias("ss_within"),
    )
    return sums.select(*keys, "groups", "total_n", "ss_between", "ss_within", *anova_columns())


def with_f_p_value(table: DataFrame) -> DataFrame:
    return table.withColumn("p", f_p_value("f_stat", "dof1", "dof2"))


def pearson(a, b):
    """Correlation over the rows where both are present; null where one of them does not vary (the built-in one fails there)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    left, right = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(left, right), F.sqrt(F.var_pop(left)) * F.sqrt(F.var_pop(right)))
