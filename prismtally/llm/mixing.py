"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates closest in relative entropy to "every document once", under one token constraint per level of one or more
columns, are exponential: a document's rate is ``exp(sum of the multipliers of its levels)``. The multipliers solve a
convex dual whose gradient is target minus tokens taken. The Hessian of one column's block is diagonal, so a Newton
step per column needs one aggregate over the table of level combinations, to which the documents are reduced
once, with partial sums before the shuffle.

Rates become whole copies: everyone gets the integer part, and the documents with the smallest hashes get one more until
the tokens of their group reach the target. The hash at which a group stops is found on a histogram of hashes and
then inside one of its bins, so no window holds more than 4096 bins or one bin of documents, and the
decision is a comparison per document, not a rank.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtally.llm.common import WORD, row_key, stored

CYCLE = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BIN_SHIFT = 52  # 4096 bins of the signed 64-bit hash
TOLERANCE = 1e-9
MAX_ROUNDS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def cycled_targets(sizes: DataFrame, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """``level``, ``tokens``, ``target``: ``share`` of all tokens by cycled weights, at most ``most`` times a level's own.

    Weights follow the code points of the levels, null last. What the bound cuts off goes to the others by weight until
    none is above: with levels ordered by bound / weight, the common level of water is the first that the next
    bound exceeds. The windows run over distinct levels, never over documents.
    """
    cycle = F.array(*[F.lit(float(w)) for w in CYCLE])
    spot = F.row_number().over(Window.orderBy(F.col("level").asc_nulls_last()))
    everything = Window.partitionBy()
    by_bound = Window.orderBy("ratio", F.col("level").asc_nulls_last())
    table = (
        sizes.withColumn("weight", cycle[(spot - 1) % len(CYCLE)])
        .withColumn("bound", most * F.col("tokens").cast("double"))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("budget", share * F.sum("tokens").over(everything))
        .withColumn("full", F.sum("bound").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("water", (F.col("budget") - F.coalesce("full", F.lit(0.0))) / F.col("open"))
    )
    first = F.min(F.when(F.col("water") <= F.col("ratio"), F.struct("ratio", "water"))).over(everything)["water"]
    target = F.least(F.col("bound"), F.coalesce(F.col("weight") * first, F.col("bound")))
    return table.select("level", "tokens", target.alias("target"))


def entropy_multipliers(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """``cells`` (one row per combination of levels, ``tokens``) with ``multiplier``, the sum over its columns.

    ``targets`` has, by column, a frame of ``level`` and ``target``; a level without a target keeps multiplier 0. Newton
    steps go column by column until every constraint holds; a step is at most 1, which keeps the exponentials finite.
    """
    state = cells.withColumn("multiplier", F.lit(0.0))
    for name, wanted in targets.items():
        state = state.join(wanted.select(F.col("level").alias("_level"), F.col("target").alias(f"_want_{name}")), F.col(name).eqNullSafe(F.col("_level")), "left").drop("_level")
    state = stored(state, "cells")
    for _ in range(MAX_ROUNDS):
        gaps = F.lit(0.0)
        for name in targets:
            level = Window.partitionBy(name)
            have = F.sum(F.col("tokens") * F.exp("multiplier")).over(level)
            want = F.col(f"_want_{name}")
            step = F.when(want.isNull() | (have <= 0), 0.0).otherwise(F.least((want - have) / have, F.lit(1.0)))
            state = state.withColumn("_step", step).withColumn("multiplier", F.col("multiplier") + F.col("_step"))
            # Multipliers below -40 stand for a target of 0.
            gaps = F.greatest(gaps, F.when(F.col("multiplier") < -40, 0.0).otherwise(F.abs("_step")))
            state = state.withColumn("_gap", gaps).drop("_step")
            gaps = F.col("_gap")
        state = stored(state, "cells")
        worst = state.agg(F.max("_gap")).first()[0]
        state = state.drop("_gap")
        if worst is None or worst <= TOLERANCE:
            break
    return state.select(*cells.columns, "multiplier")


def _stops(bins: DataFrame, items: DataFrame, goals: DataFrame) -> DataFrame:
    """``cell``, ``stop`` and ``got``: the hash up to which documents are taken so that ``got`` is nearest to ``goal``."""
    running = Window.partitionBy("cell").orderBy("bin")
    upto = bins.join(goals, "cell").where("goal > 0").withColumn("upto", F.sum("tokens").over(running))
    edge = upto.groupBy("cell").agg(
        F.max("goal").alias("goal"),
        F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before")))).alias("hit"),
        F.max("upto").alias("all"),
    )
    inside = edge.where("hit IS NOT NULL").select("cell", "goal", "hit.bin", "hit.before")
    cut = items.join(inside, ["cell", "bin"]).groupBy("cell", "goal", "bin", "before", "u").agg(F.sum("size").alias("size"))
    step = cut.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("cell").orderBy("u")))
    start = F.shiftleft(F.col("bin"), BIN_SHIFT)
    none = inside.select("cell", F.try_subtract(start, F.lit(1)).alias("stop"), F.col("before").alias("got"), "goal")
    some = step.select("cell", F.col("u").alias("stop"), F.col("upto").alias("got"), "goal")
    best = none.unionAll(some).groupBy("cell").agg(F.min_by(F.struct("stop", "got"), F.struct(F.abs(F.col("got") - F.col("goal")), "stop")).alias("b"))
    whole = edge.where("hit IS NULL").select("cell", F.lit(2**63 - 1).alias("stop"), F.col("all").alias("got"))
    return best.select("cell", "b.stop", "b.got").unionAll(whole)


def copy_plan(slim: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """One row per combination of levels: whole copies for all, and the hashes at which long and short documents stop.

    ``slim`` has the columns of ``targets``, ``size`` and ``u`` (a hash of the row). The long documents (above the mean) are
    settled first and what they miss goes to the short ones, so a group ends within a short document of its target.
    """
    names = list(targets)
    cells = slim.groupBy(*names).agg(F.sum("size").alias("tokens"), F.avg("size").alias("mean"))
    rates = entropy_multipliers(stored(cells.withColumn("cell", F.xxhash64(*names, *[F.col(c).isNull() for c in names])), "cells"), targets)
    # A rate a hair below a whole number, by rounding of the Newton steps, is that number.
    rates = rates.withColumn("rate", F.round(F.exp("multiplier"), 8)).withColumn("base", F.floor("rate"))
    rates = stored(rates.withColumn("extra", F.col("rate") - F.col("base")), "rates")
    keyed = rates.select(*[F.col(c).alias(f"_{c}") for c in names], "cell", "mean")
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    items = slim.join(keyed, match).select("cell", (F.col("size") > F.col("mean")).alias("long"), "u", F.shiftright("u", BIN_SHIFT).alias("bin"), "size")
    bins = stored(items.groupBy("cell", "long", "bin").agg(F.sum("size").alias("tokens")), "bins")
    sums = bins.groupBy("cell").agg(
        F.coalesce(F.sum(F.when(F.col("long"), F.col("tokens"))), F.lit(0)).alias("long_tokens"),
        F.coalesce(F.sum(F.when(~F.col("long"), F.col("tokens"))), F.lit(0)).alias("short_tokens"),
    )
    wanted = stored(rates.select("cell", "extra").join(sums, "cell"), "wanted")
    long_goal = wanted.select("cell", (F.col("extra") * F.col("long_tokens")).alias("goal"))
    long_stop = stored(_stops(bins.where("long").drop("long"), items.where("long").drop("long"), long_goal), "stops")
    short_goal = wanted.join(long_stop, "cell", "left").select(
        "cell", (F.col("extra") * (F.col("long_tokens") + F.col("short_tokens")) - F.coalesce("got", F.lit(0))).alias("goal")
    )
    short_stop = _stops(bins.where("NOT long").drop("long"), items.where("NOT long").drop("long"), short_goal)
    return stored(
        rates.select(*names, "cell", "tokens", "mean", "rate", "base")
        .join(long_stop.select("cell", F.col("stop").alias("long_stop")), "cell", "left")
        .join(short_stop.select("cell", F.col("stop").alias("short_stop")), "cell", "left"),
        "plan",
    )


def copies(size: Column, u: Column) -> Column:
    """Copies of a document beside its row of the plan."""
    stop = F.when(size > F.col("mean"), F.col("long_stop")).otherwise(F.col("short_stop"))
    return (F.col("base") + F.coalesce((u <= stop).cast("long"), F.lit(0))).cast("long")


def mixed(docs: DataFrame, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``copies``.

    A null text has size 0; a null source is a source of its own; documents of size 0 follow the hash like any other; rows
    that repeat in id and text share one decision. An empty table gives an empty result. Reruns agree.
    """
    slim = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key("doc_id", "text").alias("u")
    )
    slim = stored(slim, "sizes")
    targets = stored(cycled_targets(slim.groupBy(F.col("source").alias("level")).agg(F.sum("size").alias("tokens")), share, most), "targets")
    plan = copy_plan(slim, {"source": targets})
    table = plan.withColumnsRenamed({"source": "_source", "tokens": "source_size"}).join(
        targets.select(F.col("level").alias("_level"), "target"), F.col("_source").eqNullSafe(F.col("_level"))
    )
    out = slim.join(table, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies(F.col("size"), F.col("u")).alias("copies"))


def expanded(docs: DataFrame, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, with its own columns.

    Texts are not shuffled: the plan has one row per source and is joined to the documents by the size Spark sees.
    """
    slim = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key("doc_id", "text").alias("u"))
    slim = stored(slim, "sizes")
    targets = stored(cycled_targets(slim.groupBy(F.col("source").alias("level")).agg(F.sum("size").alias("tokens")), share, most), "targets")
    plan = copy_plan(slim, {"source": targets}).select(F.col("source").alias("_source"), "mean", "base", "long_stop", "short_stop")
    inner = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    marked = docs.select(inner, F.col("source").cast("string").alias("_of"), word_count(F.col("text")).alias("_size"), row_key("doc_id", "text").alias("_u"))
    counted = marked.join(plan, F.col("_of").eqNullSafe(F.col("_source"))).select("_row", copies(F.col("_size"), F.col("_u")).alias("_n"))
    return counted.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")
