"""Rule specs and their compilation to columns and SQL text."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.functions.text import blank_sql
from rulemill.schemas import RULE_SCHEMA

# Names of the condition shapes.
FIELD, THRESHOLD, MISSING = "field_comparison", "field_threshold", "missing_field"
SCALED, AFFINE = "scaled_field_comparison", "affine_field_comparison"
SUM, COMPOUND = "sum_fields_comparison", "compound_threshold_and"


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _sql_operator(op: str) -> str:
    return {"==": "=", "!=": "<>"}.get(op, op)


def plain_number(x: float) -> str:
    return f"{x:.15g}"


@dataclass(frozen=True)
class Rule:
    rule_name: str
    tag: str
    severity: str
    complexity: str
    declarative_friendly: bool
    condition_type: str
    operator: str = ""
    left: tuple[str, ...] = ()
    right: str | None = None
    threshold: float | None = None
    factor: float | None = None
    offset: float | None = None
    clauses: tuple[tuple[str, str, float], ...] = ()
    # "sum" rules may subtract instead, and "missing" rules may demand both tests: only mutants use these.
    variant: str = field(default="", compare=True)

    def _offset_text(self) -> str:
        return f"{'-' if self.offset < 0 else '+'} {abs(self.offset)}"

    @property
    def condition(self) -> str:
        """The condition as shown to reviewers."""
        kind = self.condition_type
        if kind == MISSING:
            return f"missing({self.left[0]})"
        if kind == FIELD:
            return f"{self.left[0]} {self.operator} {self.right}"
        if kind == THRESHOLD:
            return f"{self.left[0]} {self.operator} {plain_number(self.threshold)}"
        if kind == SCALED:
            return f"{self.left[0]} {self.operator} ({self.right} * {self.factor})"
        if kind == AFFINE:
            return f"{self.left[0]} {self.operator} ({self.factor} * {self.right} {self._offset_text()})"
        if kind == SUM:
            return f"({self.left[0]} + {self.left[1]}) {self.operator} ({self.right} {self._offset_text()})"
        return " && ".join(f"{name} {op} {float(x)}" for name, op, x in self.clauses)

    @property
    def sql_condition(self) -> str:
        """The condition as SQL text; blank means spaces only here."""
        if self.condition_type == MISSING:
            return f"{self.left[0]} IS NULL OR TRIM({self.left[0]}) = ''"
        if self.condition_type == COMPOUND:
            return self.condition.replace("&&", "AND")
        return self.condition

    @property
    def fields(self) -> tuple[str, ...]:
        names = [*self.left, *([self.right] if self.right else []), *[c[0] for c in self.clauses]]
        return tuple(dict.fromkeys(names))

    def expression(self, blank: Callable[[str], str] = blank_sql) -> str:
        """The predicate as one SQL expression that is never null, with double constants.

        Text rather than nested columns: a pack of many rules is then parsed in a single call.
        """
        kind, op = self.condition_type, _sql_operator(self.operator)
        if kind == MISSING:
            return "false" if self.variant == "and" else f"({blank(quoted(self.left[0]))})"
        if kind == COMPOUND:
            tests = [f"{quoted(name)} {_sql_operator(o)} {float(x)!r}D" for name, o, x in self.clauses]
            return f"coalesce({' AND '.join(tests)}, false)"
        left = quoted(self.left[0])
        if kind == THRESHOLD:
            right = f"{float(self.threshold)!r}D"
        elif kind == FIELD:
            right = quoted(self.right)
        elif kind == SCALED:
            right = f"{quoted(self.right)} * {float(self.factor)!r}D"
        elif kind == AFFINE:
            right = f"{float(self.factor)!r}D * {quoted(self.right)} + {float(self.offset)!r}D"
        elif kind == SUM:
            left = f"{left} {'-' if self.variant == 'minus' else '+'} {quoted(self.left[1])}"
            right = f"{quoted(self.right)} + {float(self.offset)!r}D"
        else:
            raise ValueError(f"unknown condition type {kind!r}")
        return f"coalesce({left} {op} {right}, false)"

    def predicate(self, blank: Callable[[str], str] = blank_sql) -> Column:
        return F.expr(self.expression(blank))

    def with_(self, **changes) -> "Rule":
        return replace(self, **changes)


# Operator swaps and perturbation sizes used for mutants.
SWAPPED = {">": ">=", "<": "<=", ">=": ">", "<=": "<", "==": "!=", "!=": "=="}
FACTOR_STEP, OFFSET_STEP, THRESHOLD_STEP = 0.3, 1.0, 1.0


def mutants(rule: Rule) -> list[tuple[str, Rule]]:
    """Slightly wrong copies of a rule. A conjunction has no single operator to swap and gets none."""
    out: list[tuple[str, Rule]] = []
    if rule.operator in SWAPPED:
        swapped = SWAPPED[rule.operator]
        out.append((f"operator_{rule.operator}_to_{swapped}", rule.with_(operator=swapped)))
    if rule.condition_type == MISSING:
        out.append(("missing_logic_or_to_and", rule.with_(variant="and")))
    if rule.condition_type == SUM:
        out.append(("sum_to_difference", rule.with_(variant="minus")))
    if rule.factor is not None:
        out.append(("scale_factor_perturbed", rule.with_(factor=round(rule.factor + FACTOR_STEP, 6))))
    if rule.condition_type == AFFINE:
        out.append(("offset_perturbed", rule.with_(offset=round(rule.offset + OFFSET_STEP, 6))))
    if rule.condition_type == THRESHOLD:
        out.append(("threshold_perturbed", rule.with_(threshold=round(rule.threshold + THRESHOLD_STEP, 6))))
    return out


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The specs as a table; it has one row per spec handed in, so its size is known here."""
    rows = []
    for position, r in enumerate(rules):
        single = r.left[0] if len(r.left) == 1 else None
        rows.append((
            position, r.rule_name, r.tag, r.severity, r.complexity, r.declarative_friendly,
            r.condition_type,
            {MISSING: "missing", COMPOUND: "&&"}.get(r.condition_type, r.operator),
            single, list(r.left) if r.condition_type == SUM else None, r.right, r.threshold,
            r.factor,
            r.offset if r.condition_type == AFFINE else None,
            r.offset if r.condition_type == SUM else None,
            [tuple(c) for c in r.clauses] or None, r.condition, r.sql_condition,
        ))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _over_limit(name: str) -> Rule:
    return Rule(f"{name}_over_105g", f"{name.replace('_', '-')}-value-over-105g", "warning", "simple", True,
                THRESHOLD, ">", (name,), threshold=105.0)


# The shipped rules in evaluation order.
SHIPPED: tuple[Rule, ...] = (
    Rule("energy_kcal_vs_kj", "energy-value-in-kcal-greater-than-in-kj", "error", "simple", True,
         FIELD, ">", ("energy_kcal",), "energy_kj"),
    Rule("energy_kj_mismatch_low", "energy-value-in-kcal-does-not-match-value-in-kj-low", "error", "intricate", False,
         AFFINE, "<", ("energy_kj",), "energy_kcal", factor=3.7, offset=-2.0),
    Rule("energy_kj_mismatch_high", "energy-value-in-kcal-does-not-match-value-in-kj-high", "error", "intricate", False,
         AFFINE, ">", ("energy_kj",), "energy_kcal", factor=4.7, offset=2.0),
    Rule("energy_kj_over_3911", "value-over-3911-energy", "error", "simple", True,
         THRESHOLD, ">", ("energy_kj",), threshold=3911.0),
    Rule("energy_kj_computed_mismatch_low",
         "energy-value-in-kj-does-not-match-value-computed-from-other-nutrients-low", "error", "intricate", False,
         AFFINE, "<", ("energy_kj_computed",), "energy_kj", factor=0.7, offset=-5.0),
    Rule("energy_kj_computed_mismatch_high",
         "energy-value-in-kj-does-not-match-value-computed-from-other-nutrients-high", "error", "intricate", False,
         AFFINE, ">", ("energy_kj_computed",), "energy_kj", factor=1.3, offset=5.0),
    Rule("saturated_fat_vs_fat", "saturated-fat-greater-than-fat", "error", "simple", True,
         AFFINE, ">", ("saturated_fat",), "fat", factor=1.0, offset=0.001),
    Rule("sugars_plus_starch_vs_carbohydrates", "sugars-plus-starch-greater-than-carbohydrates", "error", "medium", True,
         SUM, ">", ("sugars", "starch"), "carbohydrates", offset=0.001),
    _over_limit("fat"),
    _over_limit("saturated_fat"),
    _over_limit("carbohydrates"),
    _over_limit("sugars"),
    Rule("main_language_code_missing", "main-language-code-missing", "bug", "simple", True, MISSING, left=("lc",)),
    Rule("main_language_missing", "main-language-missing", "bug", "simple", True, MISSING, left=("lang",)),
    Rule("ca_allergen_evidence_missing_ingredients_text", "ca-allergen-evidence-but-missing-ingredients-text",
         "warning", "medium", True, COMPOUND,
         clauses=(("allergen_evidence_present", ">", 0.0), ("ingredients_text_present", "==", 0.0))),
    Rule("ca_contains_statement_without_allergen_evidence", "ca-contains-statement-without-allergen-evidence",
         "warning", "medium", True, COMPOUND,
         clauses=(("contains_statement_present", ">", 0.0), ("allergen_evidence_present", "==", 0.0))),
    Rule("ca_fop_required_but_symbol_missing", "ca-fop-required-but-symbol-missing", "error", "medium", True, COMPOUND,
         clauses=(("fop_threshold_exceeded", ">", 0.0), ("fop_symbol_present", "==", 0.0),
                  ("fop_exempt_proxy", "==", 0.0), ("product_is_prepackaged_proxy", ">", 0.0))),
    Rule("ca_fop_symbol_present_but_not_required", "ca-fop-symbol-present-but-not-required", "warning", "medium", True,
         COMPOUND,
         clauses=(("fop_symbol_present", ">", 0.0), ("fop_threshold_exceeded", "==", 0.0),
                  ("fop_exempt_proxy", "==", 0.0), ("product_is_prepackaged_proxy", ">", 0.0))),
    Rule("ca_fop_symbol_present_on_exempt_product", "ca-fop-symbol-present-on-exempt-product", "warning", "medium", True,
         COMPOUND,
         clauses=(("fop_symbol_present", ">", 0.0), ("fop_exempt_proxy", ">", 0.0),
                  ("product_is_prepackaged_proxy", ">", 0.0))),
)
SHIPPED_BY_NAME = {rule.rule_name: rule for rule in SHIPPED}
