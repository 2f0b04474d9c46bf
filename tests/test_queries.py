"""Registered queries against their SQL. Set ALL_QUERIES=1 to run every one; by default one per group of operators."""
from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = (
    "count_violations", "sample_violations", "product_tags", "rule_verdicts", "sql_verdicts", "tags_from_verdicts",
    "rule_pack_as_udf", "pred_sum_comparison", "rule_main_language_code_missing", "parity_full_outer", "failed_case_rows",
    "parity_counts", "parity_counts_from_verdicts", "beta_credible_bounds", "rule_result", "rule_comparison",
    "pivot_rule_frame", "normalize_products", "scan_raw_jsonl_first_n", "ingest_products", "build_rule_ir",
    "attach_profile_metadata", "issue_description", "current_values_display", "rank_fixes", "review_sheet",
    "parse_manual_edit", "coerce_edit_value", "validate_review", "patch_chain", "apply_patches_join", "feedback_counts",
    "feedback_weights", "revalidated_status", "mutation_score", "rule_semantic_cases", "counterexamples",
)
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else list(CHOSEN)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    run, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert run(spark, SF_DIR).count() > 0
    else:
        assert differences(spark, duck, run, sql, SF_DIR) is None


def test_keys_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 19
