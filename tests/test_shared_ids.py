"""Issues of different products that share a short id are reviewed, applied and revalidated as two."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rulemill.functions.hashing import issue_id
from rulemill.operators.evaluate import Pack, sql_pack
from rulemill.plans import workflows as W
from rulemill.rules.spec import SHIPPED
from rulemill.schemas import PRODUCT_COLUMNS, PRODUCT_SCHEMA

# Two issues whose ids meet by chance.
SHARED = "52bedae1ec37"
LOW = ("81371-5-3291-656-1998-11-06", "energy_kj_mismatch_low")
SYMBOL = ("114786-6-19494-662-1998-01-24", "ca_fop_symbol_present_but_not_required")
BASE = Pack("baseline", tuple(r for r in SHIPPED if r.rule_name in (LOW[1], SYMBOL[1])))


def _products(spark):
    values = {"lc": "en", "lang": "en", "language_code": "en", "ingredients_text": "x", "energy_kcal": 100.0, "energy_kj": 418.4,
              "fop_threshold_exceeded": 0, "fop_symbol_present": 0, "fop_exempt_proxy": 0, "product_is_prepackaged_proxy": 1}
    rows = [{**values, "product_id": LOW[0], "energy_kj": 100.0}, {**values, "product_id": SYMBOL[0], "fop_symbol_present": 1},
            {**values, "product_id": "clean"}]
    return spark.createDataFrame([tuple(r.get(c) for c in PRODUCT_COLUMNS) for r in rows], PRODUCT_SCHEMA)


def _compared(products):
    return W.run_comparison(products, BASE, [sql_pack("dbt", BASE.rules)],
                            W.conversions(products.sparkSession, BASE.rules, {"dbt": "dbt_core"}), BASE.rules).comparison


def test_issues_that_share_an_id_are_told_apart(spark, tmp_path):
    products = _products(spark)
    ids = products.select(issue_id(F.lit(LOW[1]), F.lit(LOW[0])), issue_id(F.lit(SYMBOL[1]), F.lit(SYMBOL[0]))).head()
    assert tuple(ids) == (SHARED, SHARED)
    store, compared, none = W.Store(spark, str(tmp_path), "r"), _compared(products), W.empty_feedback(spark)
    out = W.export_review(products, BASE, compared, none, store)
    assert sorted(map(tuple, out["issues"].select("product_id", "rule_name", "issue_id").collect())) == [
        (*SYMBOL, SHARED), (*LOW, SHARED)]
    low = F.col("rule_name") == LOW[1]
    sheet = out["sheet"].withColumns({
        "user_action": F.when(low, "approve").otherwise("reject"),
        "selected_fix_id": F.when(low, F.split_part("suggested_fix_1", F.lit(" | "), F.lit(1))).otherwise("")})
    done = W.apply_review(sheet, out["issues"], products, none, store, "2026-01-01T00:00:00Z")
    assert {r.product_id: (r.energy_kj, r.fop_symbol_present) for r in done["corrected"].collect()} == {
        LOW[0]: (418.4, 0), SYMBOL[0]: (418.4, 1), "clean": (418.4, 0)}
    assert [(r.issue_id, r.product_id, r.field) for r in done["patches"].collect()] == [(SHARED, LOW[0], "energy_kj")]
    assert {(r.issue_id, r.product_id, r.issue_status) for r in done["decisions"].collect()} == {
        (SHARED, LOW[0], "approved"), (SHARED, SYMBOL[0], "rejected")}
    assert {(r.issue_id, r.rule_name, r.issue_status) for r in done["sheet"].collect()} == {
        (SHARED, LOW[1], "applied"), (SHARED, SYMBOL[1], "pending_review")}
    assert tuple(done["summary"].select("review_rows", "approved_rows", "rejected_rows", "applied_patch_count").head()) == (2, 1, 1, 1)
    again = W.revalidate(out, done["corrected"], done["sheet"], compared, _compared(done["corrected"]), BASE, store)
    assert {(r.rule_name, r.issue_status) for r in again["sheet"].collect()} == {
        (LOW[1], "revalidated_resolved"), (SYMBOL[1], "pending_review")}
    assert {r.rule_name: (r.resolved_issues, r.remaining_issues, r.introduced_issues) for r in again["matched"].collect()} == {
        LOW[1]: (1, 0, 0), SYMBOL[1]: (0, 1, 0)}


def test_a_repeated_row_of_a_shared_id_is_refused(spark, tmp_path):
    products, none = _products(spark), W.empty_feedback(spark)
    store = W.Store(spark, str(tmp_path), "r")
    out = W.export_review(products, BASE, _compared(products), none, store)
    sheet = out["sheet"].unionAll(out["sheet"].where(F.col("rule_name") == LOW[1]).withColumn("row_idx", F.lit(9).cast("long")))
    with pytest.raises(ValueError, match=f"Row 9: duplicate issue_id `{SHARED} {LOW[1]} {LOW[0]}`"):
        W.apply_review(sheet, out["issues"], products, none, W.Store(spark, str(tmp_path), "s"), "2026-01-01T00:00:00Z")
