"""Every registered query against its SQL statement at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"I15_model_driver", "I17_dataset_summary", "I17_key_insights"}  # the detectors have unit tests

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query_matches_its_statement(spark, db, name):
    assert compare(spark, db, SF_DIR, name) == ""


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
