"""What the learned rules are fitted on: one row per labelled id, whatever the table holds of it."""

from pyspark.sql import functions as F

from prismtally.llm import quality

GOOD = "these are some words of a text that nobody would throw away because it is fine"


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "learn_rules", lambda x, bad, held_out: seen.append(len(bad)) or [])
    rows = [(0, f"{GOOD} number {k}") for k in range(1000)] + [(1, GOOD + " $$$"), (2, GOOD), (None, GOOD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    assert quality.fit_rules(docs, labels) == [] and seen == [2]
    quality.fit_rules(docs, labels, limit=1)
    assert seen[1] == 1
    quality.fit_rules(docs.where("doc_id > 90"), labels)
    assert seen[2] == 0


def test_the_row_that_teaches_does_not_depend_on_the_layout(spark):
    rows = [(k % 40, " ".join([GOOD] * (1 + k % 3)) + (" $$ %% ##" * (k % 5) if k % 40 < 15 else "")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") >= 15).cast("int").alias("quality"))
    fitted = [quality.fit_rules(docs.repartition(p), labels) for p in (1, 7)]
    assert fitted[0] == fitted[1]
