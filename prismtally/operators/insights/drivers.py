"""Modelled drivers of measures by random forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtally.functions.columns import as_text, local_frame, number
from prismtally.functions.forest import BINS, Category, Number, Target, fit_forests
from prismtally.functions.quantiles import bin_ends, quantile_row
from prismtally.operators.insights.common import few_valued, findings, fixed, no_findings, say

# Gates and forest settings.
DRIVER_VALUES = 15
DRIVER_ROWS, DRIVER_TARGET_VALUES = 30, 8
TREES, LEAF, SEED = 180, 3, 42
LEAST_R2, LEAST_IMPORTANCE, KEPT = 0.2, 0.18, 1


def usable_dimensions(df: DataFrame, dimensions: list[str]) -> list[str]:
    """Dimensions with at most 15 distinct values, exactly counted behind a sketch."""
    small = few_valued(df, dimensions, DRIVER_VALUES)
    if not small:
        return []
    row = df.agg(*[F.count_distinct(as_text(df, c)).alias(f"c{i}") for i, c in enumerate(small)]).first()
    return [c for i, c in enumerate(small) if row[i] <= DRIVER_VALUES]


def driver_models(
    df: DataFrame, targets: list[str], dimensions: list[str], measures: list[str], trees: int = TREES
) -> dict[str, tuple[dict[str, float], float, int]]:
    """Per target that passes the gates: (importance per source column, R squared, rows with a value of it).

    Features of a target are the dimensions and the other measures. Missing categories become the most frequent one and missing
    numbers the median of the rows that have the target. Gates, modes, medians, bins and the forests are those of all rows, taken for
    all targets at once.
    """
    value = {m: number(df, m) for m in dict.fromkeys([*targets, *measures])}

    def where_known(target: str, c: Column) -> Column:
        return F.when(value[target].isNotNull(), c)

    aggs = [f(value[t]).alias(f"{k}{i}") for i, t in enumerate(targets) for k, f in (("n", F.count), ("u", lambda v: F.approx_count_distinct(v, 0.02)))]
    modes = [F.mode(where_known(t, as_text(df, d)), deterministic=True).alias(f"m{i}_{j}") for i, t in enumerate(targets) for j, d in enumerate(dimensions)]
    texts = [F.collect_set(as_text(df, d)).alias(f"t{j}") for j, d in enumerate(dimensions)]
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *aggs, *modes, *texts).first()
    numbers_of = {t: [m for m in measures if m != t] for t in targets}
    kept = []
    for i, t in enumerate(targets):
        few = facts[f"u{i}"] < 2 * DRIVER_TARGET_VALUES and df.agg(F.count_distinct(value[t])).first()[0] < DRIVER_TARGET_VALUES
        if facts[f"n{i}"] >= DRIVER_ROWS and not few:
            kept.append((i, t))
    # Targets without gaps share the medians and the bins of whole columns.
    gaps = {t for i, t in kept if facts[f"n{i}"] < facts["rows"]}
    keys = {(t, m): f"{t if t in gaps else ''}\0{m}" for _, t in kept for m in numbers_of[t]}
    wanted = {key: where_known(t, value[m]) if t in gaps else value[m] for (t, m), key in keys.items()}
    medians = {key: q[0] for key, q in quantile_row(df, wanted, [0.5]).items() if q is not None}
    filled = {key: where_known(t, F.coalesce(value[m], F.lit(medians[key]))) if t in gaps else F.coalesce(value[m], F.lit(medians[key])) for (t, m), key in keys.items() if key in medians}
    ends = bin_ends(df, filled, BINS)

    places = {m: f"v{k}" for k, m in enumerate(value)}
    numbers = {(key, m): Number(places[m], np.array(ends[key]), medians[key], m) for (_, m), key in keys.items() if key in medians}
    shared: dict[tuple[int, str], Category] = {}
    models, about = [], []
    for i, t in kept:
        features: list[Category | Number] = []
        for j, d in enumerate(dimensions):
            mode = facts[f"m{i}_{j}"]
            if mode is not None:
                features.append(shared.setdefault((j, mode), Category(f"d{j}", sorted(facts[f"t{j}"]), mode, d)))
        features += [numbers[keys[t, m], m] for m in numbers_of[t] if keys[t, m] in medians]
        if features:
            models.append(Target(places[t], features))
            about.append((t, int(facts[f"n{i}"])))
    slim = df.select(*[as_text(df, d).alias(f"d{j}") for j, d in enumerate(dimensions)], *[v.alias(places[m]) for m, v in value.items()])
    fitted = fit_forests(slim, models, trees, LEAF, SEED)
    return {t: (importance, r2, n) for (t, n), (importance, r2) in zip(about, fitted, strict=True)}


def model_driver_insights(df: DataFrame, dimensions: list[str], measures: list[str], trees: int = TREES) -> DataFrame:
    """The strongest modelled driver of each measure, best one kept."""
    usable = usable_dimensions(df, dimensions)
    if not usable or len(measures) < 2:
        return no_findings(df)
    results = []
    for target, (importance, r2, n) in driver_models(df, measures, usable, measures, trees).items():
        top = max(importance, key=importance.get)
        if r2 >= LEAST_R2 and importance[top] >= LEAST_IMPORTANCE:
            results.append((target, top, "bar" if top in usable else "scatter", importance[top], r2, n))
    if not results:
        return no_findings(df)
    rows = local_frame(
        df.sparkSession, results, "measure string, driver string, chart string, importance double, r2 double, n long"
    )
    importance, r2 = F.col("importance"), F.col("r2")
    return findings(
        rows,
        KEPT,
        ["A random forest on segment columns and peer numbers.", "Directional, not causal."],
        kind=F.lit("model_driver"),
        title=say(F.col("driver"), " looks like the strongest modeled driver of ", F.col("measure")),
        detail=say(
            "A forest accounts for ", fixed(r2 * 100, 1), "% of the variance, and ", fixed(importance * 100, 1),
            "% of its splits' gain is due to ", F.col("driver"), ".",
        ),
        score=F.round(importance * 100, 3),
        stat=say("R² = ", fixed(r2, 2), " / top importance = ", fixed(importance * 100, 1), "%"),
        chart_type=F.col("chart"),
        chart_columns=F.array("driver", "measure"),
        sample_size=F.col("n"),
        effect=F.greatest(r2, importance),
        stability=F.least(F.lit(1.0), r2),
    )
