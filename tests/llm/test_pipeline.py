"""The corpus pipeline on the smallest driver tables, and registered SQL of this folder."""

import os

import oracle
import pytest

import corpus_pipeline
from ledgerline.llm import queries  # noqa: F401
from ledgerline.llm.registry import QUERIES, SQL, table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def test_each_operator_has_a_query():
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF_DIR), SF_DIR, QUERIES[name], SQL[name]) is None


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF_DIR).cache()
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids and len(left) > 0.7 * len(ids), name
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == ids
