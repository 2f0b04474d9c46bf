"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing to target weights and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulemill.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from rulemill.llm.common import read_table
from rulemill.session import materialize

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("secret_scan", secret_scan.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

# Learned rules, sketches, automata and tokenizers have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
