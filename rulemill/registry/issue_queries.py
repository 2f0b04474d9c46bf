"""Issues, fixes, ranks and the review sheet."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.functions.text import format_value
from rulemill.operators import fixes as X
from rulemill.operators import issues as I
from rulemill.registry import query
from rulemill.registry.adapter import P_CTE, products
from rulemill.registry.core import BASE
from rulemill.registry.parity_queries import FINAL_CTE, comparison, rule_metadata
from rulemill.registry.rule_sql import V_CTE
from rulemill.rules.packs import REGIONAL_METADATA
from rulemill.rules.spec import SHIPPED
from rulemill.schemas import NUMBER_COLUMNS, PRODUCT_COLUMNS, REVIEW_COLUMNS
from rulemill.session import new_path
from rulemill.sources import sheets


def issue_rules(spark):
    """Rule rows as a comparison would give them, with a fixed choice per rule."""
    return rule_metadata(spark).withColumns({
        "confidence": F.lit(0.91237), "migration_state": F.lit("accepted"), "migration_state_reason": F.lit("checked"),
        "best_engine": F.when(F.col("declarative_friendly"), "dbt").otherwise("python"), "rule_ir_hash": F.lit("abc")})


def issues(spark, sf_dir):
    return I.issues_join(products(spark, sf_dir), BASE, issue_rules(spark))


def ranked(spark, sf_dir):
    return X.with_ranked_fixes(issues(spark, sf_dir), X.FIX.names)


# ---- the same in SQL -------------------------------------------------------------------------

def shown_sql(c: str) -> str:
    return f"coalesce(regexp_replace(printf('%.3f', {c}), '\\.?0+$', ''), 'blank')"


_REQUIRED = {row[0]: row[9] for row in REGIONAL_METADATA}
# Fields of every rule, written out: required ones first, then those of the condition.
FIELDS = {
    "energy_kcal_vs_kj": ["energy_kj", "energy_kcal"],
    "energy_kj_mismatch_low": ["energy_kj", "energy_kcal"],
    "energy_kj_mismatch_high": ["energy_kj", "energy_kcal"],
    "energy_kj_over_3911": ["energy_kj"],
    "energy_kj_computed_mismatch_low": ["energy_kj", "energy_kj_computed"],
    "energy_kj_computed_mismatch_high": ["energy_kj", "energy_kj_computed"],
    "saturated_fat_vs_fat": ["fat", "saturated_fat"],
    "sugars_plus_starch_vs_carbohydrates": ["carbohydrates", "sugars", "starch"],
    "fat_over_105g": ["fat"], "saturated_fat_over_105g": ["saturated_fat"],
    "carbohydrates_over_105g": ["carbohydrates"], "sugars_over_105g": ["sugars"],
    **{name: list(fields) for name, fields in _REQUIRED.items()},
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, cases: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _show(field: str) -> str:
    return shown_sql(field) if field in NUMBER_COLUMNS else f"coalesce(CAST({field} AS VARCHAR), 'blank')"


_DISPLAY = {n: " || ', ' || ".join(f"'{f}=' || {_show(f)}" for f in fs) for n, fs in FIELDS.items()}
_CONDITION = {r.rule_name: r.condition for r in SHIPPED}
_DESCRIBE = {
    **{n: _q(f"The recorded nutrition values do not fit the expected relationship: {_CONDITION[n]}.")
       for n in _CONDITION if "mismatch" in n},
    **{n: _q(f"This product violates the rule: {_CONDITION[n]}.") for n in _CONDITION if n.startswith("ca_")},
    **{f"{n}_over_105g": f"'{n.replace('_', ' ').title()} is ' || {shown_sql(n)} || ', above the allowed maximum of 105.'"
       for n in ("fat", "saturated_fat", "carbohydrates", "sugars")},
    "main_language_code_missing": "'Main language code is blank for this product.'",
    "main_language_missing": "'Main language is blank for this product.'",
    "energy_kj_over_3911": f"'Energy in kJ is ' || {shown_sql('energy_kj')} || ', above the 3911 upper limit.'",
    "energy_kcal_vs_kj": f"'Energy in kcal (' || {shown_sql('energy_kcal')} || ') is greater than energy in kJ (' ||"
                         f" {shown_sql('energy_kj')} || ').'",
    "saturated_fat_vs_fat": f"'Saturated fat (' || {shown_sql('saturated_fat')} || ') is greater than total fat (' ||"
                            f" {shown_sql('fat')} || ').'",
    "sugars_plus_starch_vs_carbohydrates":
        f"'Sugars + starch (' || {shown_sql('sugars')} || ' + ' || {shown_sql('starch')} ||"
        f" ') exceeds carbohydrates (' || {shown_sql('carbohydrates')} || ').'",
}
_EXPLAIN = {
    **I.EXPLANATIONS,
    **{f"{n}_over_105g": f"{n.replace('_', ' ').title()} should not be greater than 105."
       for n in ("fat", "saturated_fat", "carbohydrates", "sugars")},
}
ISSUE_CTE = f"""{P_CTE}, {V_CTE},
  r(rule_name, tag, severity, condition, condition_type, jurisdiction, best_engine, rule_explanation) AS (VALUES {', '.join(
    '(' + ', '.join(map(_q, (x.rule_name, x.tag, x.severity, x.condition, x.condition_type,
                             'ca' if x.rule_name in _REQUIRED else 'global',
                             'dbt' if x.declarative_friendly else 'python', _EXPLAIN[x.rule_name]))) + ')'
    for x in SHIPPED)}),
  i AS (SELECT substr(sha1(v.rule_name || ':' || product_id), 1, 12) AS issue_id, v.rule_name, p.*,
          r.* EXCLUDE (rule_name), {_case('v.rule_name', _DESCRIBE)} AS issue_description,
          {_case('v.rule_name', _DISPLAY)} AS current_values_display
        FROM v JOIN p USING (product_id) JOIN r ON r.rule_name = v.rule_name)"""
WITH_ISSUES = f"WITH {ISSUE_CTE}"
_FORMULA = {
    "105.0": "'105.0'", "3911.0": "'3911.0'", "1": "'1'", "0": "'0'", "": "''",
    "kj_from_kcal": "CAST(round(coalesce(energy_kcal, 0) * CAST(4.184 AS DOUBLE), 2) AS VARCHAR)",
    "kcal_from_kj": "CAST(round(coalesce(energy_kj, 0) / CAST(4.184 AS DOUBLE), 2) AS VARCHAR)",
    "sugars_plus_starch": "CAST(round(coalesce(sugars, 0) + coalesce(starch, 0), 3) AS VARCHAR)",
    "carbohydrates_left": "CAST(round(greatest(coalesce(carbohydrates, 0) - coalesce(sugars, 0), 0), 3) AS VARCHAR)",
    **{n: f"CAST({n} AS VARCHAR)" for n in ("energy_kj", "energy_kj_computed", "fat", "saturated_fat")},
    **{n: f"coalesce({n}, '')" for n in ("lc", "lang", "language_code")},
}
_KIND = {"null": "'null'", "1": "'int'", "0": "'int'", "": "'string'",
         **{n: "'string'" for n in ("lc", "lang", "language_code")}}


def _template_rows() -> str:
    rows = []
    for r in SHIPPED:
        family = ("over_limit" if r.rule_name.endswith("_over_105g")
                  else r.rule_name.removesuffix("_low").removesuffix("_high") if "mismatch" in r.rule_name else r.rule_name)
        field = r.rule_name.removesuffix("_over_105g")
        for at, f in enumerate((*X.FIXES[family], X.MANUAL_FIX)):
            suffix, change, target, formula, confidence, explanation, outcome, strategy = f
            change = change.replace("{label}", field.replace("_", " "))
            rows.append("(" + ", ".join((
                _q(r.rule_name), str(at), _q(suffix), _q(change), _q(target.replace("{field}", field)), _q(formula),
                f"CAST({confidence} AS DOUBLE)", _q(explanation), _q(outcome), _q(strategy))) + ")")
    return ", ".join(rows)


_BONUS = _case("fix_strategy", {k: f"CAST({v} AS DOUBLE)" for k, v in X.STRATEGY_BONUS.items()})
FIX_CTE = f"""{ISSUE_CTE},
  t(rule_name, pos, suffix, change, target_field, formula, confidence, explanation, expected_outcome, fix_strategy)
    AS (VALUES {_template_rows()}),
  f0 AS (SELECT i.*, t.* EXCLUDE (rule_name), {_case('formula', _KIND, "'double'")} AS kind0,
           {_case('formula', _FORMULA)} AS new_value FROM i JOIN t USING (rule_name)),
  f AS (SELECT *, issue_id || '_' || suffix AS fix_id, replace(change, '{{value}}', coalesce(new_value, ''))
          AS suggested_change, CASE WHEN new_value IS NULL THEN 'null' ELSE kind0 END AS new_kind
        FROM f0 WHERE NOT (fix_strategy = 'copy_existing_value' AND new_value = ''))"""
WITH_FIXES = f"WITH {FIX_CTE}"
SCORE = f"""confidence + {_BONUS} + CAST(0 AS DOUBLE)
  + CASE WHEN severity = 'error' AND fix_strategy <> 'manual_review_required' THEN CAST(0.02 AS DOUBLE) ELSE 0 END
  + CASE WHEN condition_type = 'missing_field' AND fix_strategy = 'copy_existing_value'
    THEN CAST(0.03 AS DOUBLE) ELSE 0 END"""
# Ranks are found on narrow rows; the texts join them afterwards.
RANK_CTE = f"""{FIX_CTE},
  ranks AS MATERIALIZED (SELECT issue_id, pos, row_number() OVER (PARTITION BY issue_id ORDER BY {SCORE} DESC, pos) AS rank FROM f),
  k AS (SELECT f.*, rank FROM f JOIN ranks USING (issue_id, pos))"""
WITH_RANKS = f"WITH {RANK_CTE}"


@query("issue_id_hash", f"{WITH_ISSUES} SELECT issue_id, rule_name, product_id FROM i")
def issue_id_hash(spark, sf_dir):
    return issues(spark, sf_dir).select("issue_id", "rule_name", "product_id")


@query("issue_explanation", f"{WITH_ISSUES} SELECT issue_id, rule_explanation FROM i")
def issue_explanation(spark, sf_dir):
    return issues(spark, sf_dir).select("issue_id", "rule_explanation")


@query("issue_description", f"{WITH_ISSUES} SELECT issue_id, issue_description FROM i")
def issue_description(spark, sf_dir):
    return issues(spark, sf_dir).select("issue_id", "issue_description")


@query("rule_fields", f"""{WITH_ISSUES}
SELECT issue_id, {_case('rule_name', {n: _q(','.join(fs)) for n, fs in FIELDS.items()})} AS fields FROM i""")
def rule_fields(spark, sf_dir):
    return issues(spark, sf_dir).select("issue_id", F.array_join("fields", ",").alias("fields"))


@query("current_values_map", f"""{WITH_ISSUES} SELECT issue_id, u.field,
  {_case('u.field', {c: (c if c in NUMBER_COLUMNS else f'try_cast({c} AS DOUBLE)') for c in PRODUCT_COLUMNS[1:]})} AS amount
FROM i, LATERAL (SELECT unnest(string_split(
  {_case('rule_name', {n: _q(','.join(fs)) for n, fs in FIELDS.items()})}, ',')) AS field) u""")
def current_values_map(spark, sf_dir):
    return issues(spark, sf_dir).select("issue_id", F.explode("current_values").alias("field", "v")).select(
        "issue_id", "field", F.expr("try_cast(v AS double)").alias("amount"))


@query("current_values_display", f"{WITH_ISSUES} SELECT issue_id, current_values_display FROM i")
def current_values_display(spark, sf_dir):
    return issues(spark, sf_dir).select("issue_id", "current_values_display")


@query("format_value", f"""WITH {P_CTE} SELECT product_id, {shown_sql('energy_kj')} AS kj, {shown_sql('starch')} AS starch,
  {shown_sql('sodium')} AS sodium, coalesce(lang, 'blank') AS lang FROM p""")
def format_value_query(spark, sf_dir):
    return products(spark, sf_dir).select(
        "product_id", format_value("energy_kj", True).alias("kj"),
        format_value("starch", True).alias("starch"), format_value("sodium", True).alias("sodium"),
        format_value("lang", False).alias("lang"))


_JOIN_COLUMNS = ("issue_id, product_id, rule_name, tag, severity, jurisdiction, condition, condition_type,"
                 " issue_description, rule_explanation, current_values_display, best_engine")


@query("issues_join", f"""WITH {FINAL_CTE}, {ISSUE_CTE.removeprefix(f'{P_CTE}, {V_CTE},')}
SELECT {', '.join('i.' + c for c in _JOIN_COLUMNS.split(', ') if c != 'best_engine')}, fc.best_engine,
  fc.effective_confidence AS confidence, fc.migration_state, fc.migration_state_reason
FROM i JOIN fc ON fc.rule_name = i.rule_name""")
def issues_join(spark, sf_dir):
    rules = I.comparison_rules(comparison(spark, sf_dir))
    return I.issues_join(products(spark, sf_dir), BASE, rules).select(
        *_JOIN_COLUMNS.split(", "), "confidence", "migration_state", "migration_state_reason")


@query("issues_top_n_per_rule", f"""{WITH_ISSUES} SELECT issue_id, rule_name, product_id FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY product_id) AS place FROM i) WHERE place <= 7""")
def issues_top_n_per_rule(spark, sf_dir):
    return I.issues_join(products(spark, sf_dir), BASE, issue_rules(spark), 7).select(
        "issue_id", "rule_name", "product_id")


@query("issues_by_rule", f"{WITH_ISSUES} SELECT rule_name, count(*) AS issue_count FROM i GROUP BY rule_name")
def issues_by_rule(spark, sf_dir):
    return I.issues_by_rule(issues(spark, sf_dir))


@query("rules_with_issues", f"{WITH_ISSUES} SELECT count(DISTINCT rule_name) AS rules_with_issues FROM i")
def rules_with_issues(spark, sf_dir):
    return I.rules_with_issues(issues(spark, sf_dir))


@query("top_rules", f"""{WITH_ISSUES} SELECT rule_name, count(*) AS issue_count FROM i GROUP BY rule_name
ORDER BY issue_count DESC, rule_name LIMIT 5""")
def top_rules(spark, sf_dir):
    return I.top_rules(issues(spark, sf_dir))


# ---- fixes -------------------------------------------------------------------------------------

_FIX_COLUMNS = ("issue_id, rule_name, fix_id, suggested_change, target_field, new_kind, confidence, explanation,"
                " expected_outcome, fix_strategy")
_NEW_NUMBER = "try_cast(new_value AS DOUBLE) AS new_number, CASE WHEN new_kind = 'string' THEN new_value END AS new_text"


def _fix_rows(df):
    return df.select("*", F.col("new_value.kind").alias("new_kind"),
                     F.expr("try_cast(new_value.value AS double)").alias("new_number"),
                     F.expr("CASE WHEN new_value.kind = 'string' THEN new_value.value END").alias("new_text"))


def _fix_query(name: str, *rules: str):
    chosen = ", ".join(_q(r) for r in rules)

    @query(name, f"{WITH_FIXES} SELECT {_FIX_COLUMNS}, {_NEW_NUMBER} FROM f WHERE rule_name IN ({chosen})"
                 " AND fix_strategy <> 'manual_review_required'")
    def run(spark, sf_dir):
        made = X.with_fixes(issues(spark, sf_dir).where(F.col("rule_name").isin(*rules)))
        rows = _fix_rows(X.explode_fixes(made, "rule_name")).where("fix_strategy <> 'manual_review_required'")
        return rows.select(*_FIX_COLUMNS.split(", "), "new_number", "new_text")


_fix_query("fix_over_limit", *[f"{n}_over_105g" for n in ("fat", "saturated_fat", "carbohydrates", "sugars")])
_fix_query("fix_energy_limit", "energy_kj_over_3911")
_fix_query("fix_energy_units", "energy_kcal_vs_kj")
_fix_query("fix_energy_mismatch", "energy_kj_mismatch_low", "energy_kj_mismatch_high")
_fix_query("fix_energy_computed", "energy_kj_computed_mismatch_low", "energy_kj_computed_mismatch_high")
_fix_query("fix_saturated_fat", "saturated_fat_vs_fat")
_fix_query("fix_carbohydrates", "sugars_plus_starch_vs_carbohydrates")
_fix_query("fix_language", "main_language_code_missing", "main_language_missing")
_fix_query("fix_allergen_flags", "ca_allergen_evidence_missing_ingredients_text",
           "ca_contains_statement_without_allergen_evidence")
_fix_query("fix_fop_flags", "ca_fop_required_but_symbol_missing", "ca_fop_symbol_present_but_not_required",
           "ca_fop_symbol_present_on_exempt_product")


@query("fix_manual_review", f"""{WITH_FIXES} SELECT issue_id, fix_id, suggested_change, target_field, new_value,
  confidence, fix_strategy FROM f WHERE fix_strategy = 'manual_review_required'""")
def fix_manual_review(spark, sf_dir):
    rows = X.explode_fixes(X.with_fixes(issues(spark, sf_dir)))
    return rows.where("fix_strategy = 'manual_review_required'").select(
        "issue_id", "fix_id", "suggested_change", "target_field", F.col("new_value.value").alias("new_value"),
        "confidence", "fix_strategy")


_REASON = ("'Ranked #' || rank || ' from base confidence ' || printf('%.2f', confidence) || ' and strategy `'"
           " || fix_strategy || '`.'")


@query("rank_fixes", f"""{WITH_RANKS}
SELECT issue_id, fix_id, CAST(rank AS INTEGER) AS rank, {_REASON} AS ranking_reason FROM k""")
def rank_fixes(spark, sf_dir):
    made = X.rank_fixes(X.with_fixes(issues(spark, sf_dir)))
    return X.explode_fixes(made).select("issue_id", "fix_id", "rank", "ranking_reason")


_CELL = ("fix_id || ' | ' || suggested_change || ' | confidence=' || printf('%.2f', confidence) || ' | '"
         " || explanation")
SHEET_CTE = f"""{RANK_CTE},
  cells AS (SELECT issue_id, max(CASE WHEN rank = 1 THEN suggested_change END) AS recommended_fix,
    {', '.join(f"coalesce(max(CASE WHEN rank = {n} THEN {_CELL} END), '') AS suggested_fix_{n}" for n in (1, 2, 3))}
    FROM k GROUP BY issue_id),
  sheet AS (SELECT i.issue_id, product_id, rule_name, severity, jurisdiction, issue_description,
      current_values_display AS current_values, rule_explanation, '0.9124' AS confidence, 'accepted' AS migration_state,
      best_engine, recommended_fix, suggested_fix_1, suggested_fix_2, suggested_fix_3, '' AS selected_fix_id,
      '' AS manual_edit, '' AS user_action, 'pending_review' AS issue_status, '' AS review_notes, '' AS reviewer_name,
      '' AS reviewed_at_utc FROM i JOIN cells USING (issue_id))"""


@query("format_fix_cell", f"WITH {SHEET_CTE} SELECT issue_id, suggested_fix_1, suggested_fix_2, suggested_fix_3 FROM sheet")
def format_fix_cell(spark, sf_dir):
    return X.review_sheet(ranked(spark, sf_dir)).select(
        "issue_id", "suggested_fix_1", "suggested_fix_2", "suggested_fix_3")


@query("review_sheet", f"WITH {SHEET_CTE} SELECT * FROM sheet")
def review_sheet(spark, sf_dir):
    return X.review_sheet(ranked(spark, sf_dir))


@query("write_review_sheet", f"WITH {SHEET_CTE} SELECT *, '' AS extra FROM sheet")
def write_review_sheet(spark, sf_dir):
    path = new_path(spark, "sheet")
    # an extra column is kept behind the fixed ones, and missing ones come back blank
    sheet = X.review_sheet(ranked(spark, sf_dir)).drop("reviewed_at_utc").withColumn("extra", F.lit(None).cast("string"))
    sheets.write_review_sheet(sheet, path)
    return sheets.scan_review_sheet(spark, path).select(*REVIEW_COLUMNS, "extra")


@query("scan_review_sheet", f"""WITH {SHEET_CTE}
SELECT issue_id, issue_description, suggested_fix_1, confidence, issue_status FROM sheet""")
def scan_review_sheet(spark, sf_dir):
    path = new_path(spark, "sheet-scan")
    sheets.write_review_sheet(X.review_sheet(ranked(spark, sf_dir)), path)
    return sheets.scan_review_sheet(spark, path).select(
        "issue_id", "issue_description", "suggested_fix_1", "confidence", "issue_status")


@query("missing_required_columns", f"WITH {SHEET_CTE} SELECT 'manual_edit,user_action' AS missing, count(*) AS row_count FROM sheet")
def missing_required_columns(spark, sf_dir):
    sheet = X.review_sheet(ranked(spark, sf_dir)).drop("manual_edit", "user_action")
    lacking = ",".join(sheets.missing_required_columns(sheet))
    return sheet.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(lacking).alias("missing"), "row_count")


@query("write_issues_json", f"{WITH_FIXES} SELECT count(DISTINCT issue_id) AS issues, count(*) AS fixes FROM f")
def write_issues_json(spark, sf_dir):
    path = new_path(spark, "issues-json")
    sheets.write_issues(ranked(spark, sf_dir).select(*I.ISSUE_COLUMNS, "fix_candidates"), path)
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("issues"),
        F.sum(F.json_array_length(F.get_json_object("value", "$.fix_candidates"))).cast("bigint").alias("fixes"))


@query("scan_issues_json", f"""{WITH_RANKS} SELECT issue_id, product_id, rule_name, current_values_display, fix_id,
  CAST(rank AS INTEGER) AS rank, new_kind FROM k""")
def scan_issues_json(spark, sf_dir):
    path = new_path(spark, "issues-scan")
    sheets.write_issues(ranked(spark, sf_dir).select(*I.ISSUE_COLUMNS, "fix_candidates"), path)
    back = sheets.scan_issues(spark, path)
    return X.explode_fixes(back, "product_id", "rule_name", "current_values_display").select(
        "issue_id", "product_id", "rule_name", "current_values_display", "fix_id", "rank",
        F.col("new_value.kind").alias("new_kind"))

