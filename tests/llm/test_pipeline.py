"""The pipeline stage by stage, and the registered queries on the smallest tables."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rulemill.session import materialize
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF_DIR), name)
        seen[name] = docs
        if name == "packing":
            break
        assert docs.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    rules = {r.doc_id: r.text for r in seen["quality_rules"].collect()}
    assert all(brute.quality_counts(t)[0] >= 10 for t in rules.values())
    near = brute.near_components(list(rules.items()), 5, 80)
    assert {r.doc_id for r in seen["minhash_near_dedup"].collect()} == {c for _, c in near.values()}
    assert all(brute.secrets(r.text)[:3] == (0, 0, 0) for r in seen["secret_scan"].collect())
    assert {r.doc_id for r in seen["mixing"].collect()} == {r.doc_id for r in seen["secret_scan"].collect()}
    assert docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


@pytest.mark.parametrize("number", range(1, 11))
def test_query(spark, number):
    [name] = [k for k in entry.queries() if k.startswith(f"op{number}_")]
    out = entry.queries()[name](spark, SF_DIR)
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert out.count() >= (rows if out.columns[0] == "doc_id" else 1)
