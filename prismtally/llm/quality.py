"""Quality rules: a decision list learned by sequential covering, applied as a Spark conditional expression.

Rules are grown one condition at a time by FOIL gain on one part of the labelled rows and pruned from the end on the
other part; a rule must be nearly free of good documents on both, else covering ends. What a rule covers leaves
the growing rows. The list is emitted as ``when(rule 1, reject).when(rule 2, reject) ... otherwise(keep)``, so
scoring is one codegen expression over the statistics and every verdict can be traced to a readable rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtally.llm.common import free_name
from prismtally.llm.textstats import statistics_column, text_statistics

MAX_LABELLED = 20_000  # rows that the learner may see; the only bound in this module
THRESHOLDS = 40
MAX_CONDITIONS = 4
MAX_RULES = 24
MIN_COVERED = 4
MAX_FALSE_SHARE = 0.02

# Features are ratios, so a rule means the same for short and long texts. 0 / 0 counts as 0.
FEATURES = {
    "repeat_share": "n_repeat_words / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "mean_word": "word_chars / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "words_per_line": "n_words / n_lines",
    "upper_share": "n_upper / (n_upper + n_lower)",
    "digits_per_char": "n_digits / word_chars",
    "endings_per_word": "n_endings / n_words",
    "words": "n_words / 1",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, prefix: str = "") -> Column:
        value = F.expr(feature_sql(self.feature, prefix))
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"{prefix}n_words < 10 OR 100 * {prefix}n_repeat_words > 20 * {prefix}n_words")


def feature_sql(name: str, prefix: str = "") -> str:
    top, bottom = re.sub(r"[a-z]\w*", lambda m: prefix + m[0], FEATURES[name]).split(" / ", 1)
    return f"coalesce(try_divide(CAST({top} AS DOUBLE), CAST({bottom} AS DOUBLE)), 0D)"


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _candidates(x: dict[str, np.ndarray]) -> list[Condition]:
    out = []
    for name, values in x.items():
        cuts = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
        spread = np.unique(np.linspace(values.min(), values.max(), THRESHOLDS // 2 + 2)[1:-1])
        for cut in np.unique(np.concatenate([cuts, spread])):
            out += [Condition(name, True, float(cut)), Condition(name, False, float(cut))]
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, candidates: list[Condition], masks: list[np.ndarray]) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        base, best, pick = log2(p0 / (p0 + n0)), 0.0, -1
        for k, mask in enumerate(masks):
            both = inside & mask
            p = int(np.count_nonzero(both & bad))
            if p < MIN_COVERED:
                continue
            gain = p * (log2(p / int(np.count_nonzero(both))) - base)
            if gain > best + 1e-9:
                best, pick = gain, k
        if pick < 0:
            break
        rule, inside = (*rule, candidates[pick]), inside & masks[pick]
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(candidate: Rule) -> float:
        inside = _covered(candidate, x, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray) -> list[Rule]:
    """Sequential covering over labelled rows; ``held`` marks the pruning part. No bad or no good row: no rule."""
    grow = {k: v[~held] for k, v in x.items()}
    prune = {k: v[held] for k, v in x.items()}
    grow_bad, prune_bad = bad[~held], bad[held]
    if not len(grow_bad) or not grow_bad.any() or grow_bad.all():
        return []
    candidates = _candidates(grow)
    masks = [c.holds(grow) for c in candidates]
    left, rules = np.ones(len(grow_bad), bool), []
    while len(rules) < MAX_RULES and int((left & grow_bad).sum()) >= MIN_COVERED:
        rule = _grow({k: v[left] for k, v in grow.items()}, grow_bad[left], candidates, [m[left] for m in masks])
        if not rule:
            break
        rule = _prune(rule, prune, prune_bad)
        clean = True
        for part, labels in ((grow, grow_bad), (prune, prune_bad)):
            inside = _covered(rule, part, len(labels))
            p, n = int((inside & labels).sum()), int((inside & ~labels).sum())
            clean &= n <= MAX_FALSE_SHARE * (p + n)
        covered = _covered(rule, grow, len(grow_bad)) & left
        if not clean or int((covered & grow_bad).sum()) < MIN_COVERED:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def usable_labels(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``label_id`` and ``bad``; ids with contradictory, null or other labels are left out.

    At most ``limit`` rows, chosen by a hash of the id, so reruns and any partitioning choose the same.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("q"))
        .where("label_id IS NOT NULL AND q IN (0, 1)")
        .groupBy("label_id")
        .agg(F.min("q").alias("q"), F.max("q").alias("top"))
        .where("q = top")
        .select("label_id", (F.col("q") == 0).alias("bad"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(limit)
    )


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    """A decision list from at most ``limit`` labels, so they may be broadcast and their statistics may reach the driver.

    Documents that fail the base rules teach nothing. Of the rows that repeat an id the one with the smallest statistics teaches, so the rows that
    reach the driver are as many as labels, however often an id occurs.
    """
    known = F.broadcast(usable_labels(labels, limit))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = text_statistics(slim.join(known, slim["doc_id"] == known["label_id"], "left_semi"))
    taken = stats.where(~base_failed()).join(known, stats["doc_id"] == known["label_id"])
    features = F.struct(*[F.expr(feature_sql(f)).alias(f) for f in FEATURES])
    rows = taken.groupBy("doc_id").agg(F.max("bad").alias("bad"), F.min(features).alias("x")).select("doc_id", "bad", "x.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    x = {f: rows[f].to_numpy(np.float64) for f in FEATURES}
    return learn_rules(x, rows["bad"].to_numpy(bool), np.arange(len(rows)) % 3 == 0)


def decision_list(rules: list[Rule], prefix: str = "") -> Column:
    """``kept`` as an ordered conditional expression over the statistics, which ``prefix`` may qualify."""
    out = F.when(base_failed(prefix), F.lit(False))
    for rule in rules:
        test = rule[0].column(prefix)
        for condition in rule[1:]:
            test = test & condition.column(prefix)
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def rule_texts(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, rule)) for rule in rules]


def judged(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every document.

    A null text has no words and fails the base rules; an empty table or one without labels has no learned rule. Rows
    that repeat an id are judged each by its own text. Other columns are not read.
    """
    verdict = decision_list(fit_rules(docs, labels, limit))
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict)


def keep_good(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows that pass, with all their columns; nothing is shuffled."""
    name = free_name(docs, "statistics")
    verdict = decision_list(fit_rules(docs, labels, limit), f"{name}.")
    return docs.withColumn(name, statistics_column(F.col("text").cast("string"))).where(verdict).drop(name)
