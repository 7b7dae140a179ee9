"""The pipeline and the registered queries of this folder over whole small tables."""

import os

import pytest

import corpus_pipeline
from prismtally.llm import mixing, packing, quality
from prismtally.llm.common import stored, table
from prismtally.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SF_DIR), "stage"))
        assert name == "packing" or frames[-1].columns == columns
    start, good, cut, single, mix, packed = frames
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    verdicts = {r["doc_id"]: r["kept"] for r in quality.judged(docs, table(spark, SF_DIR, "labels")).collect()}
    assert ids(good) == sorted(i for i, kept in verdicts.items() if kept)

    from tests.llm.test_jaccard import plain_groups
    from tests.llm.test_passages import plain_runs

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    kept = [(i, t) for i, t, gone in plain_runs(rows) if not gone or (t or "").split()]
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == dict(kept)
    assert cut.where("n_chars <> length(text)").count() == good.where("n_chars <> length(text)").count()

    texts = sorted((r["doc_id"], r["text"]) for r in cut.collect())
    label, _ = plain_groups([t for _, t in texts])
    assert ids(single) == [texts[k][0] for k in sorted(set(label))]

    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(single).collect()}
    assert ids(mix) == sorted(i for i, n in copies.items() for _ in range(n))

    total = packed.agg({"length": "sum"}).first()[0]
    assert packed.where("start = 0").count() == mix.count() and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert packed.select("sequence_id").distinct().count() <= total // packing.CAPACITY + 25


def test_run_is_the_composition_of_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
