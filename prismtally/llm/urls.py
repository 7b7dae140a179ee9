"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

All work on urls is JVM-side: parsing, rules and n-grams are SQL functions, hashing and scoring are MLlib's. The model
has ``features`` weights however many urls there are, and it is fitted on a small labelled table of urls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4)
FEATURES = 1 << 14
ALLOW, BLOCK = "allow", "block"

Rule = tuple[str, str, str]  # host, path, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case (A-Z) and the path after it; both empty without a ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parse_rule(text: str, verdict: str) -> Rule:
    """``example.org/es/`` is host ``example.org`` and path ``/es/``."""
    host, slash, path = text.partition("/")
    return host, slash + path, verdict


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as a struct of ``rule`` and ``verdict``, null if none does.

    A rule fits its host and all subdomains if the path starts with its path. Of equally long rules the one with the
    longer host wins, then the smaller text. Each rule is one condition of a single expression, so rules cost no join.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    chain = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == name) | host.endswith(F.lit(f".{name}"))) & path.startswith(F.lit(start))
        made = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, made) if chain is None else chain.when(fits, made)
    return out if chain is None else chain.otherwise(out)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they come from; the ends are marked too."""

    def cut(mark: str, part: Column, n: int) -> Column:
        text = F.concat(F.lit("^"), part, F.lit("$"))
        last = F.length(text) - n + 1
        spots = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))

    return F.concat(*[cut(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in GRAMS])


def _hashed(df: DataFrame, features: int) -> DataFrame:
    return HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features").transform(df)


def fit_urls(labelled: DataFrame, features: int = FEATURES, penalty: float = 0.02) -> LogisticRegressionModel:
    """A model of ``blocked`` (0 or 1) given ``url``. Rows with a null are left out; one class alone gives a constant model."""
    rows = labelled.where("url IS NOT NULL AND blocked IN (0, 1)")
    host, path = host_and_path(F.col("url"))
    ready = _hashed(rows.select(grams(host, path).alias("grams"), F.col("blocked").cast("double").alias("label")), features)
    # The labelled table is small; one partition makes the sums, and so the model, the same in every run.
    return LogisticRegression(regParam=penalty, maxIter=60).fit(ready.coalesce(1))


def judged(urls: DataFrame, rules: Sequence[Rule], model: LogisticRegressionModel | None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``blocked_probability``.

    A rule decides where one fits, else the model does at a probability of one half; without a model such urls are
    allowed. A null url has an empty host and path. Repeated rows are judged alike; other columns are not read.
    """
    host, path = host_and_path(F.col(url_column).cast("string"))
    parsed = urls.select(F.col(id_column), host.alias("host"), path.alias("path"))
    found = parsed.withColumn("found", rule_column(F.col("host"), F.col("path"), rules))
    if model is None:
        scored = found.withColumn("blocked_probability", F.lit(0.0))
    else:
        ready = _hashed(found.withColumn("grams", grams(F.col("host"), F.col("path"))), model.numFeatures)
        scored = model.transform(ready).withColumn("blocked_probability", vector_to_array("probability")[1])
    guess = F.when(F.col("blocked_probability") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        id_column, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", guess).alias("verdict"), "blocked_probability"
    )
