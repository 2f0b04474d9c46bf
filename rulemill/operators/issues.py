"""Violations to reviewable issues. Rule texts are prepared once per rule and broadcast; rows never shuffle."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.functions import hashing
from rulemill.functions.text import format_value_sql
from rulemill.operators.evaluate import Pack, violation_rows
from rulemill.operators.ranking import first_n_per_key
from rulemill.schemas import NUMBER_COLUMNS, PRODUCT_COLUMNS

KNOWN_FIELDS = PRODUCT_COLUMNS[1:]
# The language columns that belong together.
LANGUAGE_FIELDS = ("lc", "lang", "language_code")
OVER_LIMIT = "_over_105g"
# Explanations by rule, and the patterns for the others.
EXPLANATIONS = {
    "energy_kj_over_3911": "Energy in kJ should stay at or below 3911.",
    "energy_kcal_vs_kj": "Energy in kcal should not exceed the recorded energy in kJ.",
    "energy_kj_mismatch_low": "Energy in kJ looks too low compared with the kcal value.",
    "energy_kj_mismatch_high": "Energy in kJ looks too high compared with the kcal value.",
    "energy_kj_computed_mismatch_low":
        "Computed energy from other nutrients looks too low compared with the declared kJ value.",
    "energy_kj_computed_mismatch_high":
        "Computed energy from other nutrients looks too high compared with the declared kJ value.",
    "saturated_fat_vs_fat": "Saturated fat should not be greater than total fat.",
    "sugars_plus_starch_vs_carbohydrates": "Sugars plus starch should not exceed total carbohydrates.",
    "main_language_code_missing": "The main language code is missing.",
    "main_language_missing": "The main language is missing.",
    "ca_allergen_evidence_missing_ingredients_text":
        "Allergen evidence is present, but ingredients text is missing.",
    "ca_contains_statement_without_allergen_evidence":
        "A contains statement exists without recorded allergen evidence.",
    "ca_fop_required_but_symbol_missing": "A front-of-pack symbol seems required but is missing.",
    "ca_fop_symbol_present_but_not_required":
        "A front-of-pack symbol is present even though it does not appear required.",
    "ca_fop_symbol_present_on_exempt_product": "A front-of-pack symbol is present on a product marked exempt.",
}
EXPLAIN_LIMIT = "{name} should not be greater than 105."
EXPLAIN_OTHER = "Check whether this product violates: {condition}."
# Descriptions by rule with the row's values in braces, and the patterns for the others.
DESCRIPTIONS = {
    "main_language_code_missing": "Main language code is blank for this product.",
    "main_language_missing": "Main language is blank for this product.",
    "energy_kj_over_3911": "Energy in kJ is {energy_kj}, above the 3911 upper limit.",
    "energy_kcal_vs_kj": "Energy in kcal ({energy_kcal}) is greater than energy in kJ ({energy_kj}).",
    "saturated_fat_vs_fat": "Saturated fat ({saturated_fat}) is greater than total fat ({fat}).",
    "sugars_plus_starch_vs_carbohydrates":
        "Sugars + starch ({sugars} + {starch}) exceeds carbohydrates ({carbohydrates}).",
}
DESCRIBE_LIMIT = "{name} is {value}, above the allowed maximum of 105."
DESCRIBE_MISMATCH = "The recorded nutrition values do not fit the expected relationship: {condition}."
DESCRIBE_OTHER = "This product violates the rule: {condition}."


def fill(template: str, **values: Column) -> Column:
    """A text with columns in the braces."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


_NAME_SQL = f"initcap(replace(replace(rule_name, '{OVER_LIMIT}', ''), '_', ' '))"
_IS_LIMIT = f"endswith(rule_name, '{OVER_LIMIT}')"


def fields_sql() -> str:
    """SQL for the fields a rule touches, from condition and required_fields.

    The required ones, those named in the condition as whole words, the language trio; product_id if none.
    """
    known = ", ".join(f"'{f}'" for f in KNOWN_FIELDS)
    trio = ", ".join(f"'{f}'" for f in LANGUAGE_FIELDS)
    found = f"""array_distinct(concat(
        filter(required_fields, f -> f <> ''),
        filter(array({known}), f -> condition rlike concat('\\\\b', f, '\\\\b')),
        CASE WHEN contains(condition, 'lc') OR contains(condition, 'lang') THEN array({trio})
             ELSE CAST(array() AS ARRAY<STRING>) END))"""
    return f"CASE WHEN size({found}) > 0 THEN {found} ELSE array('product_id') END"


def explanation_sql() -> str:
    """SQL over rule_name and condition."""
    own = " ".join(f"WHEN '{rule}' THEN '{text}'" for rule, text in EXPLANATIONS.items())
    return f"""CASE WHEN {_IS_LIMIT} THEN {fill_sql(EXPLAIN_LIMIT, name=_NAME_SQL)}
        ELSE CASE rule_name {own} ELSE {fill_sql(EXPLAIN_OTHER, condition='condition')} END END"""


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Adds the fields, the explanation and the parts of the description to one row per rule."""
    return rules.withColumns({"fields": F.expr(fields_sql()), "rule_explanation": F.expr(explanation_sql()),
                              "description_parts": F.expr(description_parts_sql())})


def shown_sql(name: str) -> str:
    """SQL for the display text of a product column."""
    return format_value_sql(name, name in NUMBER_COLUMNS)


def by_field_sql(make) -> str:
    """SQL of a lambda body: the text of the column that f names. Only that column is formatted."""
    cases = " ".join(f"WHEN '{name}' THEN {make(name)}" for name in PRODUCT_COLUMNS)
    return f"CASE f {cases} END"


CURRENT_VALUES = f"map_from_arrays(fields, transform(fields, f -> {by_field_sql(lambda n: f'CAST(`{n}` AS STRING)')}))"
CURRENT_DISPLAY = f"array_join(transform(fields, f -> concat(f, '=', {by_field_sql(shown_sql)})), ', ')"


def fill_sql(template: str, **values: str) -> str:
    """SQL for a text with expressions in the braces."""
    parts = [f"'{part}'" if at % 2 == 0 else values[part]
             for at, part in enumerate(re.split(r"[{}]", template))]
    return f"concat({', '.join(parts)})"


def _parts_sql(template: str) -> str:
    """SQL of an array of parts (text, field) from a text with fields in braces."""
    pieces = re.split(r"[{}]", template)
    fields = [f"'{name}'" for name in pieces[1::2]] + ["CAST(NULL AS STRING)"]
    return f"array({', '.join(f"""named_struct('text', '{text}', 'field', {field})""" for text, field in zip(pieces[::2], fields))})"


def description_parts_sql() -> str:
    """SQL over rule_name and condition: the texts of a description, each with the field whose value follows it or null.

    Worked out once per rule: a row only prints the few values that its rule names.
    """
    limit = f"substring(rule_name, 1, length(rule_name) - {len(OVER_LIMIT)})"
    own = " ".join(f"WHEN rule_name = '{rule}' THEN {_parts_sql(text)}" for rule, text in DESCRIPTIONS.items())

    def whole(template: str) -> str:
        text = fill_sql(template, condition="condition")
        return f"CASE WHEN condition IS NOT NULL THEN array(named_struct('text', {text}, 'field', CAST(NULL AS STRING))) END"

    before, _, after = DESCRIBE_LIMIT.partition("{value}")
    limited = f"""array(named_struct('text', {fill_sql(before, name=_NAME_SQL)}, 'field', {limit}),
        named_struct('text', '{after}', 'field', CAST(NULL AS STRING)))"""
    return f"""CASE
        WHEN {_IS_LIMIT} THEN {limited}
        {own}
        WHEN contains(rule_name, 'mismatch') THEN {whole(DESCRIBE_MISMATCH)}
        ELSE {whole(DESCRIBE_OTHER)} END"""


def _shown_number_sql(field: str) -> str:
    """SQL for the display text of the number column that a field names; another name gives the text of a null."""
    cases = " ".join(f"WHEN '{name}' THEN `{name}`" for name in NUMBER_COLUMNS)
    return format_value_sql(f"CASE {field} {cases} END", True)


DESCRIPTION = f"""array_join(transform(description_parts, q ->
    CASE WHEN q.field IS NULL THEN q.text ELSE concat(q.text, {_shown_number_sql('q.field')}) END), '')"""


ISSUE_COLUMNS = (
    "issue_id", "product_id", "rule_name", "tag", "severity", "jurisdiction", "condition", "condition_type",
    "issue_description", "rule_explanation", "current_values", "current_values_display", "confidence",
    "migration_state", "migration_state_reason", "best_engine", "rule_ir_hash",
)


def build_issues(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Violating product rows (with rule_name) to issues, product columns kept for the fixes.

    rules has one row per rule: tag, severity, jurisdiction, condition, condition_type, required_fields,
    confidence, migration_state, migration_state_reason, best_engine, rule_ir_hash. Violations of rules
    that it lacks are left out.
    """
    joined = violations.join(F.broadcast(prepare_rules(rules)), "rule_name")
    return joined.withColumns({
        "issue_id": hashing.issue_id(F.col("rule_name"), F.col("product_id")),
        "issue_description": F.expr(DESCRIPTION),
        "current_values": F.expr(CURRENT_VALUES),
        "current_values_display": F.expr(CURRENT_DISPLAY),
    }).drop("description_parts")


def issues_join(products: DataFrame, pack: Pack, rules: DataFrame, max_per_rule: int | None = None) -> DataFrame:
    """Issues of a product table, optionally only the first of every rule by product id."""
    rows = violation_rows(products, pack)
    if max_per_rule is not None:
        rows = issues_top_n_per_rule(rows, max_per_rule)
    return build_issues(rows, rules)


def issues_top_n_per_rule(rows: DataFrame, n: int) -> DataFrame:
    return first_n_per_key(rows, ["rule_name"], [F.col("product_id")], n, ["product_id"]).drop("row_rank")


def comparison_rules(comparison: DataFrame, rule_hashes: DataFrame | None = None) -> DataFrame:
    """The rule columns that build_issues needs, from a rule comparison."""
    rows = comparison.select(
        "rule_name", "tag", "severity", "jurisdiction", "condition", "condition_type", "required_fields",
        F.col("effective_confidence").alias("confidence"), "migration_state", "migration_state_reason", "best_engine")
    if rule_hashes is None:
        return rows.withColumn("rule_ir_hash", F.lit(""))
    return rows.join(F.broadcast(rule_hashes.select("rule_name", "rule_ir_hash")), "rule_name", "left")


def issues_by_rule(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule_name").agg(F.count(F.lit(1)).alias("issue_count"))


def top_rules(issues: DataFrame, limit: int = 5) -> DataFrame:
    return issues_by_rule(issues).orderBy(F.desc("issue_count"), "rule_name").limit(limit)


def rules_with_issues(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_distinct("rule_name").alias("rules_with_issues"))


