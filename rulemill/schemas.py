"""Explicit schemas of the tables that the operators read and write."""
from __future__ import annotations

from pyspark.sql import types as T

# The product columns in table order.
NUMBER_COLUMNS = (
    "energy_kj", "energy_kj_computed", "energy_kcal", "fat", "saturated_fat",
    "carbohydrates", "sugars", "starch", "sodium",
)
FLAG_COLUMNS = (
    "ingredients_text_present", "contains_statement_present", "allergen_evidence_present",
    "fop_threshold_exceeded", "fop_symbol_present", "fop_exempt_proxy",
    "product_is_prepackaged_proxy",
)
LANGUAGE_COLUMNS = ("lc", "lang", "language_code")
PRODUCT_COLUMNS = (
    "product_id", *NUMBER_COLUMNS, "ingredients_text", *FLAG_COLUMNS, *LANGUAGE_COLUMNS,
)


def column_type(name: str) -> T.DataType:
    if name in NUMBER_COLUMNS:
        return T.DoubleType()
    if name in FLAG_COLUMNS:
        return T.IntegerType()
    return T.StringType()


PRODUCT_SCHEMA = T.StructType([T.StructField(name, column_type(name)) for name in PRODUCT_COLUMNS])

VERDICT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("product_id", T.StringType()),
])

# A value of any type, kept as text together with its kind: null, int, double or string.
TYPED_VALUE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
])

CLAUSE = T.StructType([
    T.StructField("left_operand", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("right_operand", T.DoubleType()),
])

RULE_SCHEMA = T.StructType([
    T.StructField("rule_order", T.IntegerType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("declarative_friendly", T.BooleanType()),
    T.StructField("condition_type", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("left_operand", T.StringType()),
    T.StructField("left_operands", T.ArrayType(T.StringType())),
    T.StructField("right_field", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("scale_factor", T.DoubleType()),
    T.StructField("offset", T.DoubleType()),
    T.StructField("right_offset", T.DoubleType()),
    T.StructField("clauses", T.ArrayType(CLAUSE)),
    T.StructField("condition", T.StringType()),
    T.StructField("sql_condition", T.StringType()),
])

FIX = T.StructType([
    T.StructField("fix_id", T.StringType()),
    T.StructField("suggested_change", T.StringType()),
    T.StructField("target_field", T.StringType()),
    T.StructField("new_value", TYPED_VALUE),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("expected_outcome", T.StringType()),
    T.StructField("fix_strategy", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("ranking_reason", T.StringType()),
])

ISSUE_SCHEMA = T.StructType([
    T.StructField("issue_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("jurisdiction", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("condition_type", T.StringType()),
    T.StructField("issue_description", T.StringType()),
    T.StructField("rule_explanation", T.StringType()),
    T.StructField("current_values", T.MapType(T.StringType(), T.StringType())),
    T.StructField("current_values_display", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("migration_state", T.StringType()),
    T.StructField("migration_state_reason", T.StringType()),
    T.StructField("best_engine", T.StringType()),
    T.StructField("rule_ir_hash", T.StringType()),
    T.StructField("fix_candidates", T.ArrayType(FIX)),
])

# The review sheet columns in file order.
REVIEW_COLUMNS = (
    "issue_id", "product_id", "rule_name", "severity", "jurisdiction", "issue_description",
    "current_values", "rule_explanation", "confidence", "migration_state", "best_engine",
    "recommended_fix", "suggested_fix_1", "suggested_fix_2", "suggested_fix_3",
    "selected_fix_id", "manual_edit", "user_action", "issue_status", "review_notes",
    "reviewer_name", "reviewed_at_utc",
)

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("fix_strategy", T.StringType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()),
])
