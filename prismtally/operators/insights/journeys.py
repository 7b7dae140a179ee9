"""Funnel and retention cohort detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismtally.functions.columns import col, moment, number, period_start, present
from prismtally.operators.insights.common import findings, fixed, grouped, no_findings, say

# Stage names in funnel order and the gates.
STAGES = ("visit", "view", "lead", "signup", "trial", "cart", "checkout", "purchase", "paid")
FUNNEL_VOLUME = 500
COHORT_IDS, COHORT_ROWS = 10, 20


def funnel_columns(measures: list[str]) -> list[str]:
    """Measures named after a stage, in funnel order (first stage found in the name)."""
    placed = []
    for c in measures:
        stage = next((i for i, s in enumerate(STAGES) if s in c.lower()), None)
        if stage is not None:
            placed.append((stage, c))
    return [c for _, c in sorted(placed)]


def funnel_steps(totals: DataFrame) -> DataFrame:
    """(position, from_stage, to_stage, conversion, drop) from (position, stage, total) rows."""
    following = Window.partitionBy(F.lit(0)).orderBy("position")  # a handful of stages
    steps = totals.select(
        "position",
        F.col("stage").alias("from_stage"),
        F.lead("stage").over(following).alias("to_stage"),
        F.col("total").alias("from_total"),
        F.lead("total").over(following).alias("to_total"),
    )
    return steps.where(F.col("to_stage").isNotNull() & (F.col("from_total") > 0)).select(
        "position",
        "from_stage",
        "to_stage",
        (F.col("to_total") / F.col("from_total") * 100).alias("conversion"),
        (F.col("from_total") - F.col("to_total")).alias("drop"),
    )


def stage_totals(df: DataFrame, stages: list[str]) -> DataFrame:
    wide = df.agg(*[F.coalesce(F.sum(number(df, s)), F.lit(0.0)).alias(f"t{i}") for i, s in enumerate(stages)])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(f"t{i}").alias("total"))
        for i, s in enumerate(stages)
    ]
    return wide.select(F.inline(F.array(*entries)))


def event_stage_totals(events: DataFrame, user: str, event_type: str, stages: list[str]) -> DataFrame:
    """The event-table form: distinct users per stage.

    Users are reduced to one row per (stage, user) before they are counted, and copies collapse
    before that shuffle, so a hot stage or a hot user stays spread out.
    """
    position = F.lit(None).cast("int")
    for i, s in enumerate(stages):
        position = F.when(col(event_type) == s, F.lit(i)).otherwise(position)
    reached = (
        events.where(col(event_type).isin(stages) & col(user).isNotNull())
        .select(position.alias("position"), col(event_type).alias("stage"), col(user).alias("user"))
        .distinct()
    )
    return reached.groupBy("position", "stage").agg(F.count(F.lit(1)).cast("double").alias("total"))


def funnel_insights(df: DataFrame, measures: list[str]) -> DataFrame:
    """I13."""
    stages = funnel_columns(measures)
    return funnel_finding(stage_totals(df, stages), stages) if len(stages) > 1 else no_findings(df)


def funnel_finding(totals: DataFrame, stages: list[str]) -> DataFrame:
    weakest = funnel_steps(totals).orderBy("conversion", "position").limit(1)
    volume = totals.agg(F.floor(F.sum(F.greatest("total", F.lit(0.0)))).cast("long").alias("volume")).scalar()
    conversion = F.col("conversion")
    return findings(
        weakest.withColumn("volume", volume),
        1,
        ["Stages are recognised by common names.", "The weakest step is the first place to look."],
        kind=F.lit("funnel"),
        title=say("Largest funnel friction appears between ", F.col("from_stage"), " and ", F.col("to_stage")),
        detail=say(
            "Of what enters this step ", fixed(conversion, 2), "% goes on; ", grouped(F.col("drop")), " is lost.",
        ),
        score=F.round(100 - conversion, 3),
        stat=say(fixed(conversion, 2), "% conversion"),
        chart_type=F.lit("bar"),
        chart_columns=F.array(*[F.lit(s) for s in stages[:2]]),
        sample_size=F.col("volume"),
        effect=F.greatest(F.lit(0.0), (100 - conversion) / 100),
        stability=F.least(F.lit(1.0), F.col("volume") / FUNNEL_VOLUME),
    )


def cohort_table(df: DataFrame, date: str, identifier: str) -> DataFrame:
    """(cohort, size, repeats, rows): an id belongs to its first month and repeats if its last
    month is a later one, so first and last timestamps per id are all that is needed (one
    map-side combined aggregate; an id with very many rows is one partial row per task)."""
    per_id = (
        df.select(present(df, identifier).alias("id"), moment(df, date).alias("ts"))
        .where(F.col("id").isNotNull() & F.col("ts").isNotNull())
        .groupBy("id")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("rows"))
    )
    cohort = period_start(F.col("first"), "month")
    repeated = period_start(F.col("last"), "month") > cohort
    return per_id.groupBy(cohort.alias("cohort")).agg(
        F.count(F.lit(1)).alias("size"), F.count_if(repeated).alias("repeats"), F.sum("rows").alias("rows")
    )


def retention_insights(df: DataFrame, dates: list[str], identifiers: list[str]) -> DataFrame:
    """I14 over all pairs of date and identifier, the best one kept; cohorts without any repeat are left out."""
    pairs = [(d, i) for d in dates for i in identifiers]
    if not pairs:
        return no_findings(df)
    cohorts = reduce(
        DataFrame.unionByName,
        [cohort_table(df, d, i).withColumns({"date_column": F.lit(d), "identifier": F.lit(i)}) for d, i in pairs],
    )
    everyone = Window.partitionBy("date_column", "identifier")  # one row per month
    rate = F.col("repeats") / F.col("size") * 100
    best = (
        cohorts.select("*", F.sum("size").over(everyone).alias("ids"), F.sum("rows").over(everyone).alias("all_rows"))
        .where((F.col("ids") >= COHORT_IDS) & (F.col("all_rows") >= COHORT_ROWS) & (F.col("repeats") > 0))
        .withColumn("rate", rate)
        .orderBy(F.desc("rate"), "cohort", "date_column", "identifier")
        .limit(1)
    )
    rate = F.col("rate")
    return findings(
        best,
        1,
        ["Cohorts are the first month of each identifier.", "Repeat activity is any later month."],
        kind=F.lit("retention_cohort"),
        title=say(F.date_format("cohort", "yyyy-MM"), " cohort has the strongest repeat activity"),
        detail=say("Of those first seen in that month, ", fixed(rate, 2), "% come back in a later one."),
        score=F.round(rate, 3),
        stat=say(fixed(rate, 2), "% repeat rate"),
        chart_type=F.lit("heatmap"),
        chart_columns=F.array("date_column", "identifier"),
        sample_size=F.col("size"),
        effect=rate / 100,
        stability=F.least(F.lit(1.0), rate / 100),
    )
