"""The shipped conditions written out as SQL, independently of the specs."""
from __future__ import annotations

RULE_SQL: dict[str, str] = {
    "energy_kcal_vs_kj": "energy_kcal > energy_kj",
    "energy_kj_mismatch_low": "energy_kj < CAST(3.7 AS DOUBLE)*energy_kcal - 2",
    "energy_kj_mismatch_high": "energy_kj > CAST(4.7 AS DOUBLE)*energy_kcal + 2",
    "energy_kj_over_3911": "energy_kj > 3911",
    "energy_kj_computed_mismatch_low": "energy_kj_computed < CAST(0.7 AS DOUBLE)*energy_kj - 5",
    "energy_kj_computed_mismatch_high": "energy_kj_computed > CAST(1.3 AS DOUBLE)*energy_kj + 5",
    "saturated_fat_vs_fat": "saturated_fat > fat + CAST(0.001 AS DOUBLE)",
    "sugars_plus_starch_vs_carbohydrates": "sugars + starch > carbohydrates + CAST(0.001 AS DOUBLE)",
    "fat_over_105g": "fat > 105",
    "saturated_fat_over_105g": "saturated_fat > 105",
    "carbohydrates_over_105g": "carbohydrates > 105",
    "sugars_over_105g": "sugars > 105",
    "main_language_code_missing": "lc IS NULL OR trim(lc) = ''",
    "main_language_missing": "lang IS NULL OR trim(lang) = ''",
    "ca_allergen_evidence_missing_ingredients_text":
        "allergen_evidence_present > 0 AND ingredients_text_present = 0",
    "ca_contains_statement_without_allergen_evidence":
        "contains_statement_present > 0 AND allergen_evidence_present = 0",
    "ca_fop_required_but_symbol_missing":
        "fop_threshold_exceeded > 0 AND fop_symbol_present = 0 AND fop_exempt_proxy = 0"
        " AND product_is_prepackaged_proxy > 0",
    "ca_fop_symbol_present_but_not_required":
        "fop_symbol_present > 0 AND fop_threshold_exceeded = 0 AND fop_exempt_proxy = 0"
        " AND product_is_prepackaged_proxy > 0",
    "ca_fop_symbol_present_on_exempt_product":
        "fop_symbol_present > 0 AND fop_exempt_proxy > 0 AND product_is_prepackaged_proxy > 0",
}


def verdict_union(conditions: dict[str, str], columns: str = "product_id", source: str = "p") -> str:
    """A UNION ALL with one branch per rule."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule_name, {columns} FROM {source} WHERE {cond}" for name, cond in conditions.items())


V_CTE = "v AS MATERIALIZED (" + verdict_union(RULE_SQL) + ")"
