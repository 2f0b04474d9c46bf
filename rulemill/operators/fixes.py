"""Fix candidates, their ranking and the review sheet. Fixes live in an array on the issue row: at most three."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.functions.text import double_text, fixed_decimals
from rulemill.operators.issues import OVER_LIMIT
from rulemill.schemas import FIX, REVIEW_COLUMNS

KJ_PER_KCAL = 4.184  # fixed value
MAX_FIXES = 3

# Fixes by rule family: id suffix, change, target, value, confidence, explanation, outcome, strategy.
# {field} and {label} stand for the limited field, {value} for the proposed text.
FIXES = {
    "over_limit": (
        ("limit", "Set {label} to 105.", "{field}", "105.0", 0.88,
         "This is the smallest change that brings the value back inside the allowed maximum.",
         "The product should stop triggering the over-105g rule.", "clamp_to_limit"),
        ("clear", "Clear {label} and review the nutrition panel.", "{field}", "null", 0.58,
         "Use this if the recorded value looks obviously wrong or unverified.",
         "The suspicious value is removed until a verified number is added.", "clear_suspicious_value"),
    ),
    "energy_kj_over_3911": (
        ("limit", "Set energy_kj to 3911.", "energy_kj", "3911.0", 0.87,
         "This directly brings the value back under the allowed maximum.",
         "The product should stop triggering the upper-limit energy rule.", "clamp_to_limit"),
        ("recalc", "Recalculate energy_kj from energy_kcal.", "energy_kj", "kj_from_kcal", 0.72,
         "Use this if the kJ value likely drifted away from the kcal declaration.",
         "The kJ value becomes consistent with the kcal field.", "derive_from_related_field"),
    ),
    "energy_kcal_vs_kj": (
        ("derive_kcal", "Recalculate energy_kcal from energy_kj.", "energy_kcal", "kcal_from_kj", 0.81,
         "This preserves the kJ value and derives the kcal value from it.",
         "Energy in kcal should no longer exceed energy in kJ.", "derive_from_related_field"),
        ("derive_kj", "Recalculate energy_kj from energy_kcal.", "energy_kj", "kj_from_kcal", 0.69,
         "Use this if the kcal number looks more trustworthy than the kJ number.",
         "The two energy fields become unit-consistent.", "derive_from_related_field"),
    ),
    "energy_kj_mismatch": (
        ("align_kj", "Align energy_kj with the kcal value.", "energy_kj", "kj_from_kcal", 0.84,
         "This uses the standard kcal-to-kJ conversion and is usually the most direct repair.",
         "The energy relationship should fall back inside the expected range.", "derive_from_related_field"),
        ("align_kcal", "Align energy_kcal with the kJ value.", "energy_kcal", "kcal_from_kj", 0.68,
         "Use this if the kJ declaration is trusted and the kcal field seems off.",
         "The energy relationship should become consistent.", "derive_from_related_field"),
    ),
    "energy_kj_computed_mismatch": (
        ("sync_computed", "Set energy_kj_computed to match energy_kj.", "energy_kj_computed", "energy_kj", 0.82,
         "This is the most direct way to align computed energy with the declared value.",
         "The computed-energy mismatch should disappear.", "align_related_fields"),
        ("sync_declared", "Set energy_kj to match energy_kj_computed.", "energy_kj", "energy_kj_computed", 0.63,
         "Use this if the computed value is believed to be more reliable than the declaration.",
         "The declared kJ value should align with the computed estimate.", "align_related_fields"),
    ),
    "saturated_fat_vs_fat": (
        ("cap_sat_fat", "Set saturated_fat to the total fat value.", "saturated_fat", "fat", 0.86,
         "Saturated fat should not exceed total fat, so this is the safest direct correction.",
         "The product should stop triggering the fat consistency rule.", "align_related_fields"),
        ("raise_fat", "Set total fat to the saturated fat value.", "fat", "saturated_fat", 0.61,
         "Use this if total fat appears under-reported compared with saturated fat.",
         "Total fat becomes at least as large as saturated fat.", "align_related_fields"),
    ),
    "sugars_plus_starch_vs_carbohydrates": (
        ("raise_carbs", "Set carbohydrates to sugars + starch.", "carbohydrates", "sugars_plus_starch", 0.84,
         "This restores the expected nutrition relationship directly.",
         "Sugars plus starch will no longer exceed carbohydrates.", "derive_from_related_field"),
        ("lower_starch", "Lower starch so sugars + starch fits within carbohydrates.", "starch",
         "carbohydrates_left", 0.69, "Use this if carbohydrates is trusted and starch looks overstated.",
         "The combined sugars and starch value should fit inside carbohydrates.", "rebalance_component"),
    ),
    "main_language_code_missing": (
        ("copy_lang", "Copy lang into lc ({value}).", "lc", "lang", 0.86,
         "The product already has a main language, so copying it into lc is the least disruptive fix.",
         "The missing main language code should be filled.", "copy_existing_value"),
        ("copy_language_code", "Copy language_code into lc ({value}).", "lc", "language_code", 0.74,
         "Use this if language_code is already the trusted source field.",
         "The missing main language code should be filled.", "copy_existing_value"),
    ),
    "main_language_missing": (
        ("copy_lc", "Copy lc into lang ({value}).", "lang", "lc", 0.86,
         "The language code is already present, so copying it into the missing field is low risk.",
         "The missing main language should be filled.", "copy_existing_value"),
        ("copy_language_code", "Copy language_code into lang ({value}).", "lang", "language_code", 0.74,
         "Use this if language_code is already the trusted source field.",
         "The missing main language should be filled.", "copy_existing_value"),
    ),
    "ca_allergen_evidence_missing_ingredients_text": (
        ("set_ingredients_present",
         "Mark ingredients_text_present as 1 after confirming ingredients text exists on the label.",
         "ingredients_text_present", "1", 0.77,
         "This keeps the allergen evidence and restores the expected supporting ingredients text signal.",
         "The Canada allergen consistency rule should stop triggering.", "restore_missing_supporting_field"),
        ("clear_allergen_evidence",
         "Set allergen_evidence_present to 0 if the allergen evidence was recorded in error.",
         "allergen_evidence_present", "0", 0.61,
         "Use this only if the allergen evidence flag is the incorrect field.",
         "The record should no longer be treated as having unsupported allergen evidence.", "clear_incorrect_flag"),
    ),
    "ca_contains_statement_without_allergen_evidence": (
        ("set_allergen_evidence", "Set allergen_evidence_present to 1.", "allergen_evidence_present", "1", 0.79,
         "This is the most direct fix when the contains statement is correct but the evidence flag is missing.",
         "The contains statement and allergen evidence will agree.", "restore_missing_supporting_field"),
        ("clear_contains_statement",
         "Set contains_statement_present to 0 if the contains statement was added by mistake.",
         "contains_statement_present", "0", 0.63,
         "Use this if the contains statement should not be present for the product.",
         "The unsupported contains statement will be removed.", "clear_incorrect_flag"),
    ),
    "ca_fop_required_but_symbol_missing": (
        ("set_symbol", "Set fop_symbol_present to 1 after confirming the package carries the symbol.",
         "fop_symbol_present", "1", 0.81,
         "This is the direct fix when the threshold logic is correct and only the symbol flag is missing.",
         "The missing front-of-pack symbol should be restored.", "restore_missing_supporting_field"),
        ("clear_threshold", "Set fop_threshold_exceeded to 0 if the product does not actually require the symbol.",
         "fop_threshold_exceeded", "0", 0.57,
         "Use this if the threshold classification is the field that is wrong.",
         "The product will no longer be considered to require the symbol.", "clear_incorrect_flag"),
    ),
    "ca_fop_symbol_present_but_not_required": (
        ("clear_symbol", "Set fop_symbol_present to 0.", "fop_symbol_present", "0", 0.82,
         "This is the safest fix if the symbol should not appear for this product.",
         "The unnecessary front-of-pack symbol will be removed.", "clear_incorrect_flag"),
        ("set_threshold", "Set fop_threshold_exceeded to 1 if the product should require the symbol.",
         "fop_threshold_exceeded", "1", 0.58,
         "Use this if the symbol is correct and the threshold flag is the missing piece.",
         "The symbol requirement logic will match the symbol presence flag.", "restore_missing_supporting_field"),
    ),
    "ca_fop_symbol_present_on_exempt_product": (
        ("clear_symbol", "Set fop_symbol_present to 0.", "fop_symbol_present", "0", 0.83,
         "If the product is truly exempt, removing the symbol flag is the least disruptive correction.",
         "The product will stop appearing as an exempt item with a symbol.", "clear_incorrect_flag"),
        ("clear_exempt_flag", "Set fop_exempt_proxy to 0 if the exemption flag is wrong.", "fop_exempt_proxy", "0", 0.56,
         "Use this when the symbol is correct and the exemption flag is the mistaken field.",
         "The product will no longer be treated as exempt.", "clear_incorrect_flag"),
    ),
}
MANUAL_FIX = (
    "manual_review", "Keep the row for manual nutrition review.", "", "", 0.35,
    "Use this when none of the suggested single-field fixes can be trusted without label review.",
    "The issue stays open for manual resolution.", "manual_review_required",
)
# Score bonus per strategy and the two extra bonuses.
STRATEGY_BONUS = {
    "clamp_to_limit": 0.05, "copy_existing_value": 0.06, "derive_from_related_field": 0.05,
    "align_related_fields": 0.04, "restore_missing_supporting_field": 0.04, "rebalance_component": 0.02,
    "clear_incorrect_flag": -0.02, "clear_suspicious_value": -0.04, "manual_review_required": -0.25,
}
ERROR_BONUS, MISSING_COPY_BONUS = 0.02, 0.03

_TEMPLATE = ("struct<suffix:string,change:string,target:string,formula:string,confidence:double,"
             "explanation:string,outcome:string,strategy:string>")


def fix_family(rule_name: Column) -> Column:
    return (
        F.when(rule_name.endswith(OVER_LIMIT), "over_limit")
        .when(rule_name.startswith("energy_kj_computed_mismatch"), "energy_kj_computed_mismatch")
        .when(rule_name.startswith("energy_kj_mismatch"), "energy_kj_mismatch")
        .otherwise(rule_name))


def family_name(rule_name: str) -> str:
    """fix_family of one name."""
    named = next((f for f in ("energy_kj_computed_mismatch", "energy_kj_mismatch") if rule_name.startswith(f)), rule_name)
    return "over_limit" if rule_name.endswith(OVER_LIMIT) else named


SLOTS = (0, 1)  # fixes of a family before the manual one


def templates_frame(spark: SparkSession) -> DataFrame:
    """One row per family with a struct column per slot: a fixed table of fourteen rows."""
    rows = [(family, *fixes) for family, fixes in FIXES.items()]
    return spark.createDataFrame(rows, "family string, " + ", ".join(f"t{k} {_TEMPLATE}" for k in SLOTS))


# SQL of the proposed values by formula name, from the columns of the product row.
_KJ = f"round(coalesce(energy_kcal, 0D) * {KJ_PER_KCAL}D, 2)"
_KCAL = f"round(coalesce(energy_kj, 0D) / {KJ_PER_KCAL}D, 2)"
NUMBER_FORMULAS = {
    "105.0": "105D", "3911.0": "3911D", "kj_from_kcal": _KJ, "kcal_from_kj": _KCAL,
    "sugars_plus_starch": "round(coalesce(sugars, 0D) + coalesce(starch, 0D), 3)",
    "carbohydrates_left": "round(greatest(coalesce(carbohydrates, 0D) - coalesce(sugars, 0D), 0D), 3)",
    **{name: name for name in ("energy_kj", "energy_kj_computed", "fat", "saturated_fat")},
}
TEXT_FORMULAS = {"": "''", **{name: f"coalesce({name}, '')" for name in ("lc", "lang", "language_code")}}
FLAG_FORMULAS = ("0", "1")


def _choose(formula: str, table: dict[str, str]) -> str:
    return f"CASE {formula} " + " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in table.items()) + " END"


# The members of a fix that checks, decisions and votes read; the others are texts for the reviewer.
DECIDING_MEMBERS = ("fix_id", "target_field", "new_value", "fix_strategy")
_SCORING_MEMBERS = ("confidence", "fix_strategy")


def _fix_struct(values: dict[str, str], members: Sequence[str]) -> str:
    return f"named_struct({', '.join(f"'{name}', {values[name]}" for name in members)})"


def _fix_sql(k: int, members: Sequence[str], ranking: Mapping[str, str] | None = None) -> str:
    """SQL of the fix in slot k from its template t<k>, its number text v<k> and its other text s<k>, with its ranking if known."""
    field = f"replace(coalesce(rule_name, ''), '{OVER_LIMIT}', '')"
    value = f"coalesce(v{k}, s{k})"
    change = f"replace(replace(t{k}.change, '{{label}}', replace({field}, '_', ' ')), '{{value}}', coalesce({value}, ''))"
    kind = (f"CASE WHEN v{k} IS NOT NULL THEN 'double' WHEN s{k} IS NULL THEN 'null'"
            f" WHEN t{k}.formula IN ('0', '1') THEN 'int' ELSE 'string' END")
    return _fix_struct({
        "fix_id": f"concat(issue_id, '_', t{k}.suffix)", "suggested_change": change,
        "target_field": f"replace(t{k}.target, '{{field}}', {field})",
        "new_value": f"named_struct('kind', {kind}, 'value', {value})", "confidence": f"t{k}.confidence",
        "explanation": f"t{k}.explanation", "expected_outcome": f"t{k}.outcome", "fix_strategy": f"t{k}.strategy",
        "rank": "0", "ranking_reason": "''", **(ranking or {})}, members)


def _is_used(k: int) -> str:
    return f"(t{k}.suffix IS NOT NULL AND NOT (t{k}.strategy = 'copy_existing_value' AND s{k} = ''))"


def _manual_sql(members: Sequence[str]) -> str:
    suffix, change, target, value, confidence, explanation, outcome, strategy = MANUAL_FIX
    return _fix_struct({
        "fix_id": f"concat(issue_id, '_{suffix}')", "suggested_change": f"'{change}'", "target_field": f"'{target}'",
        "new_value": f"named_struct('kind', 'string', 'value', '{value}')", "confidence": f"{confidence}D",
        "explanation": f"'{explanation}'", "expected_outcome": f"'{outcome}'", "fix_strategy": f"'{strategy}'",
        "rank": "0", "ranking_reason": "''"}, members)


def with_fixes(issues: DataFrame, members: Sequence[str] = tuple(FIX.names)) -> DataFrame:
    """Adds fix_candidates to issues that still carry their product columns, in the order they are thought of.

    Each slot is worked out in generated code, one projection after the other, so that a number is
    computed and printed once; only the small array is put together at the end. Numbers are printed in a function over
    both slots: as plain columns that code outgrows what the virtual machine compiles. members are those of
    a fix that are wanted; those that give its score come along.
    """
    members = [name for name in FIX.names if name in {*members, *_SCORING_MEMBERS}]
    templates = F.broadcast(templates_frame(issues.sparkSession))
    joined = issues.withColumn("family", fix_family(F.col("rule_name"))).join(templates, "family", "left")
    flags = {name: f"'{name}'" for name in FLAG_FORMULAS}
    chosen = joined.withColumns({
        **{f"n{k}": F.expr(_choose(f"t{k}.formula", NUMBER_FORMULAS)) for k in SLOTS},
        **{f"s{k}": F.expr(_choose(f"t{k}.formula", {**TEXT_FORMULAS, **flags})) for k in SLOTS}})
    texts = chosen.withColumn("texts", F.transform(F.array(*[f"n{k}" for k in SLOTS]), double_text))
    printed = texts.withColumns({f"v{k}": F.get("texts", F.lit(k)) for k in SLOTS})
    # a copy of an empty text is no fix; neither is a slot that the family does not have
    use = {k: _is_used(k) for k in SLOTS}
    made = printed.withColumns({f"f{k}": F.expr(_fix_sql(k, members)) for k in SLOTS}).withColumn(
        "fm", F.expr(_manual_sql(members)))
    fixes = F.expr(f"""CASE WHEN {use[0]} AND {use[1]} THEN array(f0, f1, fm) WHEN {use[0]} THEN array(f0, fm)
        WHEN {use[1]} THEN array(f1, fm) ELSE array(fm) END""")
    helpers = [f"{c}{k}" for c in "tnsvf" for k in SLOTS]
    return made.withColumn("fix_candidates", fixes).drop("family", "fm", "texts", *helpers)


def rank_fixes(issues: DataFrame, members: Sequence[str] = tuple(FIX.names)) -> DataFrame:
    """Fixes sorted by score, best first, with rank and reason; equal scores keep their order. members are those to keep.

    Uses severity and condition_type, and the map column weights (strategy to feedback weight) if present.
    All within the row.
    """
    has_weights = "weights" in issues.columns

    def weight(fix: str) -> str:
        return f"coalesce(try_element_at(weights, {fix}.fix_strategy), 0D)" if has_weights else "0D"

    def score(f: str) -> str:
        bonus = _choose(f"{f}.fix_strategy", {name: f"{x}D" for name, x in STRATEGY_BONUS.items()})
        return f"""{f}.confidence + coalesce({bonus}, 0D) + {weight(f)}
            + CASE WHEN severity = 'error' AND {f}.fix_strategy <> 'manual_review_required' THEN {ERROR_BONUS}D ELSE 0D END
            + CASE WHEN condition_type = 'missing_field' AND {f}.fix_strategy = 'copy_existing_value'
                   THEN {MISSING_COPY_BONUS}D ELSE 0D END"""

    def kept(fix: str, r: str) -> str:
        feedback = f"""CASE WHEN {weight(fix)} = 0 THEN '' ELSE concat(' Reviewer feedback ',
            CASE WHEN {weight(fix)} > 0 THEN 'boosted' ELSE 'down-ranked' END, ' this strategy by ',
            format_number(abs({weight(fix)}), 2), '.') END""" if has_weights else "''"
        reason = f"""concat('Ranked #', {r} + 1, ' from base confidence ', format_number({fix}.confidence, 2),
            ' and strategy `', {fix}.fix_strategy, '`.', {feedback})"""
        values = {**{n: f"{fix}.{n}" for n in FIX.names}, "rank": f"{r} + 1", "ranking_reason": reason}
        return _fix_struct(values, [n for n in FIX.names if n in members])

    # each fix travels with its sort key, so the array is read once
    ordered = f"sort_array(transform(fix_candidates, (f, i) -> named_struct('s', -({score('f')}), 'i', i, 'f', f)))"
    ranked = f"transform({ordered}, (k, r) -> {kept('k.f', 'r')})"
    if "ranking_reason" in members:
        return issues.withColumn("fix_candidates", F.expr(ranked))
    # Up to MAX_FIXES fixes are put in order by comparisons, which unlike functions stay in generated code. _b01: fix 0 comes
    # before fix 1; _p0: the place of the best. A fix without a score comes first, as in a sorted array.
    # The function for longer lists also keeps Spark from joining this step with those before it to more code than is compiled.
    keys = ", ".join(f"-({score(f'get(fix_candidates, {i})')})" for i in range(MAX_FIXES))
    scored = issues.withColumn("_s", F.expr(
        f"CASE WHEN size(fix_candidates) <= {MAX_FIXES} THEN array({keys}) ELSE transform(fix_candidates, f -> -({score('f')})) END"))
    before = scored.withColumn("_n", F.size("fix_candidates")).withColumns({
        f"_b{i}{j}": F.expr(f"_n <= {j} OR get(_s, {i}) IS NULL OR coalesce(get(_s, {i}) <= get(_s, {j}), false)")
        for i in range(MAX_FIXES) for j in range(i + 1, MAX_FIXES)})
    ends = before.withColumns({
        "_p0": F.expr("CASE WHEN _b01 AND _b02 THEN 0 WHEN NOT _b01 AND _b12 THEN 1 ELSE 2 END"),
        "_p2": F.expr("CASE WHEN _b02 AND _b12 THEN 2 WHEN _b01 AND NOT _b12 THEN 1 ELSE 0 END")})
    places = ends.withColumn("_p1", F.expr("3 - _p0 - _p2"))
    fixes = [kept(f"get(fix_candidates, _p{i})", str(i)) for i in range(MAX_FIXES)]
    few = " ".join(f"WHEN _n = {n} THEN array({', '.join(fixes[:n])})" for n in range(1, MAX_FIXES + 1))
    return places.withColumn("fix_candidates", F.expr(f"CASE {few} ELSE {ranked} END")).select(*issues.columns)


_FORMULA_CODES = {name: code for code, name in enumerate((*NUMBER_FORMULAS, *TEXT_FORMULAS, *FLAG_FORMULAS))}


def _ranked_templates(
    spark: SparkSession, members: Sequence[str], weights: Mapping[str, Mapping[str, float]],
) -> DataFrame:
    """A row per family, severity and condition type (is it the one that earns a bonus), with a struct per fix, best first.

    The structs hold what the members need, since they are copied for every issue; code stands for the formula, reason for
    the ranking reason behind the rank. Rules with weights have rows of their own.
    """
    needed = {"suggested_change": "change", "confidence": "confidence", "explanation": "explanation",
              "expected_outcome": "outcome"}
    names = ("suffix", "change", "target", "formula", "confidence", "explanation", "outcome", "strategy")
    kept = [n for n in names if n in ("suffix", "target", "formula", "strategy") or n in [needed.get(m) for m in members]]

    def score(fix, weight: float, error: bool, missing: bool) -> float:
        base = fix[4] + STRATEGY_BONUS.get(fix[7], 0.0) + weight
        base += ERROR_BONUS if error and fix[7] != MANUAL_FIX[7] else 0.0
        return base + (MISSING_COPY_BONUS if missing and fix[7] == "copy_existing_value" else 0.0)

    def reason(fix, weight: float) -> str:
        text = f" from base confidence {fix[4]:,.2f} and strategy `{fix[7]}`."
        turn = "boosted" if weight > 0 else "down-ranked"
        return text + (f" Reviewer feedback {turn} this strategy by {abs(weight):,.2f}." if weight else "")

    # no family: the manual fix alone
    families = [("", family, fixes, {}) for family, fixes in {**FIXES, "": ()}.items()]
    families += [(rule, "", FIXES.get(family_name(rule), ()), given) for rule, given in weights.items()]
    rows = []
    for rule, family, fixes, given in families:
        for error, missing in ((False, False), (False, True), (True, False), (True, True)):
            # equal scores keep their order
            best = sorted((*fixes, MANUAL_FIX), key=lambda f: score(f, given.get(f[7], 0.0), error, missing), reverse=True)
            slots = [(*[f[names.index(n)] for n in kept], _FORMULA_CODES.get(f[3]), reason(f, given.get(f[7], 0.0))) for f in best]
            rows.append((rule, family, error, missing, *slots, *[None] * (MAX_FIXES - len(slots))))
    template = ",".join([f"{n}:{'double' if n == 'confidence' else 'string'}" for n in kept] + ["code:int", "reason:string"])
    return spark.createDataFrame(rows, "_rule string, _family string, _error boolean, _missing boolean, " + ", ".join(
        f"t{k} struct<{template}>" for k in range(MAX_FIXES)))


def with_ranked_fixes(
    issues: DataFrame, members: Sequence[str] = DECIDING_MEMBERS, weights: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """rank_fixes(with_fixes(issues, members), members), which needs no sorting of rows.

    The order of the fixes follows from their family, the severity and the condition type: templates come in that order from
    a table of some rows per family, and a fix that is left out does not change the order of the others. weights are the
    feedback weights by rule and strategy, instead of a column weights in the rows.
    """
    if "weights" in issues.columns:
        return rank_fixes(with_fixes(issues, members), members)
    members, weights = [name for name in FIX.names if name in members], weights or {}
    slots = range(MAX_FIXES)
    family, own = fix_family(F.col("rule_name")), F.coalesce(F.col("rule_name").isin(*weights), F.lit(False))
    joined = issues.withColumns({
        "_rule": F.when(own, F.col("rule_name")).otherwise(""),
        "_family": F.when(~own & family.isin(*FIXES), family).otherwise(""),
        "_error": F.coalesce(F.col("severity") == "error", F.lit(False)),
        "_missing": F.coalesce(F.col("condition_type") == "missing_field", F.lit(False)),
    }).join(F.broadcast(_ranked_templates(issues.sparkSession, members, weights)), ["_rule", "_family", "_error", "_missing"])

    def by_code(k: int, table: dict[str, str]) -> Column:
        return F.expr(f"CASE t{k}.code " + " ".join(f"WHEN {_FORMULA_CODES[n]} THEN {sql}" for n, sql in table.items()) + " END")

    texts = {**TEXT_FORMULAS, **{name: f"'{name}'" for name in FLAG_FORMULAS}}
    chosen = joined.withColumns({
        **{f"n{k}": by_code(k, NUMBER_FORMULAS) for k in slots}, **{f"s{k}": by_code(k, texts) for k in slots}})
    printed = chosen.withColumn("texts", F.transform(F.array(*[f"n{k}" for k in slots]), double_text)).withColumns(
        {f"v{k}": F.get("texts", F.lit(k)) for k in slots})
    # r<k>: the rank of the fix in slot k, counted over those in use
    used = printed.withColumns({f"u{k}": F.expr(_is_used(k)) for k in slots}).withColumns(
        {f"r{k}": F.expr(" + ".join(["1", *[f"CAST(u{j} AS INT)" for j in range(k)]])) for k in slots})
    made = used.withColumns({f"f{k}": F.expr(_fix_sql(
        k, members, {"rank": f"r{k}", "ranking_reason": f"concat('Ranked #', r{k}, t{k}.reason)"})) for k in slots})
    uses = [[k for k in slots if at >> k & 1] for at in reversed(range(1, 2 ** MAX_FIXES))]
    cases = " ".join(f"WHEN {' AND '.join(f'u{k}' for k in use)} THEN array({', '.join(f'f{k}' for k in use)})" for use in uses)
    helpers = [f"{c}{k}" for c in "tnsvfur" for k in slots]
    return made.withColumn("fix_candidates", F.expr(f"CASE {cases} END")).drop(
        "_rule", "_family", "_error", "_missing", "texts", *helpers)


def explode_fixes(issues: DataFrame, *keep: str) -> DataFrame:
    """One row per fix. An issue always has one; the outer form keeps Spark from testing the array in a filter of its own."""
    return issues.select("issue_id", *keep, F.explode_outer("fix_candidates").alias("f")).select(
        "issue_id", *keep, "f.*")


def format_fix_cell(fix: Column) -> Column:
    return F.coalesce(F.concat_ws(
        " | ", fix["fix_id"], fix["suggested_change"],
        F.concat(F.lit("confidence="), fixed_decimals(fix["confidence"], 2)), fix["explanation"]), F.lit(""))


def fix_cell(i: int) -> Column:
    fix = F.get("fix_candidates", F.lit(i))
    return F.when(F.size("fix_candidates") > i, format_fix_cell(fix)).otherwise("")


def review_sheet(issues: DataFrame) -> DataFrame:
    """Issues with ranked fixes to the rows of a review sheet; the reviewer's columns start blank."""
    made = {
        "current_values": F.col("current_values_display"),
        "confidence": F.round("confidence", 4).cast("string"),
        "recommended_fix": F.coalesce(F.get("fix_candidates", F.lit(0))["suggested_change"], F.lit("")),
        **{f"suggested_fix_{i + 1}": fix_cell(i) for i in range(MAX_FIXES)},
        "issue_status": F.lit("pending_review"),
        **{c: F.lit("") for c in ("selected_fix_id", "manual_edit", "user_action", "review_notes", "reviewer_name",
                                  "reviewed_at_utc")},
    }
    return issues.select(*[made.get(c, F.col(c)).alias(c) if c in made else F.col(c) for c in REVIEW_COLUMNS])


