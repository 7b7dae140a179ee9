"""Key candidates and relationship suggestions between datasets."""

from __future__ import annotations

from collections.abc import Mapping
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from prismtally.functions.distinct import SKETCH_ERROR, column_sketches, distinct_values, most_shared
from prismtally.functions.frequencies import key_text
from prismtally.functions.rounding import nearest
from prismtally.session import checkpointed, scratch_path

# Name hints, weights and thresholds of the key and relationship scores.
KEY_NAME_HINTS = ("id", "key", "code", "number", "no")
UNIQUE_WEIGHT, PRESENT_WEIGHT, NAME_BONUS = 0.65, 0.25, 0.2
MIN_PRESENT, MIN_UNIQUE, PRIMARY_UNIQUE = 0.7, 0.55, 0.95
KEYS_PER_DATASET = 8
OVERLAP_WEIGHT, SIMILARITY_WEIGHT, KEY_WEIGHT = 0.7, 0.2, 0.1
MIN_CONFIDENCE = 0.35
SUGGESTIONS = 12

SUGGESTION_SCHEMA = (
    "left_dataset string, left_column string, right_dataset string, right_column string, confidence double, "
    "overlap_score double, name_similarity double, recommended_join string"
)

BITS = 60  # columns per membership word


def spark_of(datasets: Mapping[str, DataFrame]) -> SparkSession:
    return next(iter(datasets.values())).sparkSession


def key_candidates(df: DataFrame, limit: int = KEYS_PER_DATASET, approximate: bool = False) -> DataFrame:
    """Columns that could identify rows, best first."""
    found = key_candidates_of({"": df}, limit, approximate).drop("dataset")
    return found.orderBy(F.desc("score"), "column")


def sketch_columns(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """The sketches of all columns of all datasets, one scan each, kept for several uses."""
    parts = [column_sketches(df).withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    path = scratch_path(spark_of(datasets), "sketches")
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    return spark_of(datasets).read.parquet(path)


def key_candidates_of(
    datasets: Mapping[str, DataFrame], limit: int = KEYS_PER_DATASET, approximate: bool = False, sketches: DataFrame | None = None
) -> DataFrame:
    """Key candidates of many datasets: (dataset, column, ratios, score, role, counts).

    One scan per dataset sketches all columns. Those whose share of different values is certainly below the gate are out; only the
    others are counted exactly, by type. With ``approximate`` the sketches are the answer.
    """
    known = (sketches if sketches is not None else sketch_columns(datasets)).select("dataset", "column", "rows", "non_null", "estimate").collect()  # a row per column
    if approximate:
        found = [tuple(r) for r in known]
    else:
        near = [r for r in known if r["non_null"] >= MIN_PRESENT * r["rows"] and r["estimate"] * (1 + SKETCH_ERROR) + 1 >= MIN_UNIQUE * r["non_null"]]
        wanted = {name: [r["column"] for r in near if r["dataset"] == name] for name in datasets}
        counted = [distinct_values(datasets[name], columns, stripped=True).withColumn("dataset", F.lit(name)) for name, columns in wanted.items() if columns]
        exact = {(r["dataset"], r["column"]): r["unique"] for r in (reduce(DataFrame.unionByName, counted).collect() if counted else [])}
        found = [(r["dataset"], r["column"], r["rows"], r["non_null"], exact.get((r["dataset"], r["column"]), 0)) for r in near]
    stats = spark_of(datasets).createDataFrame(found, "dataset string, column string, rows long, non_null long, unique long").coalesce(1)
    hint = F.lit(False)
    for token in KEY_NAME_HINTS:
        hint = hint | F.lower("column").contains(token)
    # From here on there is one row per column: the windows are bounded by the schemas.
    in_dataset = Window.partitionBy("dataset")
    scored = (
        stats.select(
            "dataset",
            "column",
            "unique",
            "rows",
            (F.col("unique") / F.greatest("non_null", F.lit(1))).alias("u"),
            (F.col("non_null") / F.greatest("rows", F.lit(1))).alias("p"),
            F.when(hint, F.lit(NAME_BONUS)).otherwise(F.lit(0.0)).alias("bonus"),
        )
        .where((F.col("p") >= MIN_PRESENT) & (F.col("u") >= MIN_UNIQUE))
    )
    score = F.least(F.lit(1.0), F.col("u") * UNIQUE_WEIGHT + F.col("p") * PRESENT_WEIGHT + F.col("bonus"))
    table = scored.select(
        "dataset",
        "column",
        nearest(F.col("u"), 3).alias("unique_ratio"),
        nearest(F.col("p"), 3).alias("non_null_ratio"),
        nearest(score, 3).alias("score"),
        F.when(F.col("u") >= PRIMARY_UNIQUE, "primary_key").otherwise("foreign_key_candidate").alias("role_hint"),
        F.col("unique").alias("unique_count"),
        F.col("rows").alias("dataset_rows"),
    )
    place = F.row_number().over(in_dataset.orderBy(F.desc("score"), "column"))
    return table.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def name_similarity(left: str, right: str) -> float:
    """1.0 for names equal without separators and case, else a matching-blocks ratio."""

    def bare(name: str) -> str:
        return "".join(ch for ch in name.lower() if ch not in "_- ")

    a, b = bare(left), bare(right)
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def membership_patterns(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """How many distinct values occur in exactly which of the columns: (words, n).

    All columns go through one shuffle keyed by value; each value becomes a bit set of the
    columns that hold it, and equal bit sets are counted. Pairs of columns are only formed on
    that short table, never on the values.
    """
    by_frame: dict[int, list[int]] = {}
    for i, (df, _) in enumerate(columns):
        by_frame.setdefault(id(df), []).append(i)
    parts = None
    for ids in by_frame.values():  # one scan per dataset, whatever the number of its columns
        df = columns[ids[0]][0]
        entries = [F.struct(key_text(df, columns[i][1]).alias("value"), F.lit(i).alias("id")) for i in ids]
        part = df.select(F.inline(F.array(*entries)))
        parts = part if parts is None else parts.unionByName(part)
    words = (len(columns) + BITS - 1) // BITS
    masks = [
        F.bit_or(
            F.when(F.floor(F.col("id") / BITS) == w, F.expr(f"shiftleft(1L, id % {BITS})")).otherwise(F.lit(0).cast("long"))
        ).alias(f"w{w}")
        for w in range(words)
    ]
    sets = parts.where(F.col("value").isNotNull()).groupBy("value").agg(*masks)
    names = [f"w{w}" for w in range(words)]
    return sets.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def overlaps(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """J5 for every pair of columns: (i, j, shared, left_unique, right_unique, overlap).

    All distinct values count (not a leading sample). Pairs without a common value are absent.
    """
    patterns = checkpointed(membership_patterns(columns))  # read three times below
    ids = F.array(*[
        F.when(F.col(f"w{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS)).cast("long")) != 0, F.lit(i))
        for i in range(len(columns))
    ])
    members = patterns.select(F.array_compact(ids).alias("ids"), "n")
    sizes = members.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("unique"))
    shared = (
        members.where(F.size("ids") > 1)
        .select("ids", F.explode("ids").alias("i"), "n")
        .select("i", F.explode("ids").alias("j"), "n")
        .where(F.col("i") < F.col("j"))
        .groupBy("i", "j")
        .agg(F.sum("n").alias("shared"))
    )
    left = sizes.select(F.col("id").alias("i"), F.col("unique").alias("left_unique"))
    right = sizes.select(F.col("id").alias("j"), F.col("unique").alias("right_unique"))
    return (
        shared.join(left, "i")
        .join(right, "j")
        .withColumn("overlap", F.col("shared") / F.least("left_unique", "right_unique"))
    )


def comparable(candidates: list[Row], sketches: DataFrame) -> list[int]:
    """Numbers of the candidates that may share enough values with one of another dataset to be suggested."""
    named = [(i, r["dataset"], r["column"], float(r["score"])) for i, r in enumerate(candidates)]
    numbered = sketches.join(F.broadcast(sketches.sparkSession.createDataFrame(named, "id int, dataset string, column string, score double")), ["dataset", "column"])
    a, b = (numbered.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "dataset", "column", "score", "estimate", "sketch")]) for side in "ab")
    pairs = a.join(b, (F.col("a_id") < F.col("b_id")) & (F.col("a_dataset") != F.col("b_dataset")))
    similarity = F.udf(name_similarity, "double")("a_column", "b_column")
    least = (MIN_CONFIDENCE - 0.0005 - similarity * SIMILARITY_WEIGHT - F.least("a_score", "b_score") * KEY_WEIGHT) / OVERLAP_WEIGHT
    both = F.theta_sketch_estimate(F.theta_intersection("a_sketch", "b_sketch")).cast("double")
    most = most_shared(both, F.col("a_estimate"), F.col("b_estimate")) / (F.least("a_estimate", "b_estimate") * (1 - SKETCH_ERROR))
    kept = pairs.where((most > 0) & (most >= least)).select("a_id", "b_id").collect()  # at most eight candidates per dataset
    return sorted({i for row in kept for i in row})


def suggest_relationships(
    datasets: Mapping[str, DataFrame],
    row_counts: Mapping[str, int] | None = None,
    limit: int = SUGGESTIONS,
) -> DataFrame:
    """The likeliest joins between datasets, best first.

    Candidate keys are at most eight per dataset and come to the driver with their scores. The sketches that found them also tell which pairs
    share certainly too few values to reach the threshold, whatever their names; a column without any other pair is not read again.
    All value overlaps of the rest are then found by one job over all datasets, and names are compared for the pairs that share a value.
    """
    spark = spark_of(datasets)
    row_counts = dict(row_counts or {})
    order = {name: i for i, name in enumerate(datasets)}
    sketches = sketch_columns(datasets)
    found = sorted(key_candidates_of(datasets, sketches=sketches).collect(), key=lambda r: (order[r["dataset"]], -r["score"], r["column"]))
    rows = [(i, r["dataset"], r["column"], float(r["score"]), row_counts.get(r["dataset"], r["dataset_rows"])) for i, r in enumerate(found)]
    keys = spark.createDataFrame(rows, "id int, dataset string, column string, score double, rows long")
    if not rows:
        return spark.createDataFrame([], SUGGESTION_SCHEMA)

    # Name and key scores alone stay below the threshold, so only pairs that share a value are formed.
    def side(mark: str, at: str) -> DataFrame:
        return keys.select(F.col("id").alias(at), *[F.col(c).alias(f"{mark}_{c}") for c in ("dataset", "column", "score", "rows")])

    compared = comparable(found, sketches)
    if not compared:
        return spark.createDataFrame([], SUGGESTION_SCHEMA)
    places = spark.createDataFrame(list(enumerate(compared)), "at int, id int")
    shared = overlaps([(datasets[found[i]["dataset"]], found[i]["column"]) for i in compared])
    for end in ("i", "j"):  # back to the numbers of all candidates
        shared = shared.withColumnRenamed(end, "at").join(F.broadcast(places), "at").drop("at").withColumnRenamed("id", end)
    pairs = shared.join(side("left", "i"), "i").join(side("right", "j"), "j").where("left_dataset <> right_dataset")
    similarity = F.udf(name_similarity, "double")("left_column", "right_column")
    scored = pairs.withColumn("similarity", similarity).withColumn(
        "confidence",
        F.col("overlap") * OVERLAP_WEIGHT + F.col("similarity") * SIMILARITY_WEIGHT + F.least("left_score", "right_score") * KEY_WEIGHT,
    )
    recommended = F.when(F.col("left_rows") >= F.col("right_rows"), "left").otherwise("inner")
    return (
        scored.where(F.col("confidence") >= MIN_CONFIDENCE)
        .select(
            "left_dataset",
            "left_column",
            "right_dataset",
            "right_column",
            nearest(F.col("confidence"), 3).alias("confidence"),
            nearest(F.col("overlap"), 3).alias("overlap_score"),
            nearest(F.col("similarity"), 3).alias("name_similarity"),
            recommended.alias("recommended_join"),
        )
        .orderBy(F.desc("confidence"), "left_dataset", "left_column", "right_dataset", "right_column")
        .limit(limit)
    )
