"""Line up verdict sources per rule, score them, choose one and decide its governance state."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.functions.text import percent, strip

# The shipped sources in tie order, and the two that are declarative.
ENGINES = ("python", "dbt", "soda")
DECLARATIVE = ("dbt", "soda")


@dataclass(frozen=True)
class Source:
    """A source of verdicts. Only procedural ones bring verification figures that count."""
    name: str
    declarative: bool


SOURCES = tuple(Source(name, name in DECLARATIVE) for name in ENGINES)
# Trust in a provider, per source; the last entry is for any other provider.
PROVIDER_FACTORS = {
    "python": ({"groq": 1.0, "simulated_fallback": 0.55}, 0.75),
    "dbt": ({"dbt_core": 1.0, "dbt_core_sql_fallback": 0.85}, 0.9),
    "soda": ({"soda_cloud": 1.0, "soda_core": 1.0, "soda_core_sql_fallback": 0.85}, 0.9),
}
OTHER_SOURCE_FACTOR = 0.8
# Prior confidence in a conversion, by condition type.
CONVERSION_PRIORS = {
    "field_comparison": 0.98,
    "field_threshold": 0.96,
    "missing_field": 0.93,
    "sum_fields_comparison": 0.91,
    "compound_threshold_and": 0.90,
    "affine_field_comparison": 0.89,
    "scaled_field_comparison": 0.88,
}
OTHER_PRIOR = 0.80
# Prior confidence in a declarative run, real or replaced by plain SQL.
DECLARATIVE_PRIOR, DECLARATIVE_FALLBACK_PRIOR = 0.99, 0.92
# Weights of the decision score and thresholds of the decisions.
REVIEW_PENALTY, EQUIVALENCE_BONUS, MUTATION_BONUS, EQUIVALENCE_PENALTY, FIT_BONUS = 0.25, 0.05, 0.05, 0.10, 0.035
CLOSE = 0.20
MIN_PARITY, MIN_MUTATION, MIN_EFFECTIVE = 0.95, 0.60, 0.10
# Tiers and states of the summaries.
TIERS = ("simple", "medium", "intricate", "unknown")
STATES = ("accepted", "candidate", "review")
PENDING_LEGAL = ("draft", "pending-mentor-review")


def lookup(c: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def provider_factor(source: Column, provider: Column) -> Column:
    name = F.lower(strip(provider))
    out = F.lit(OTHER_SOURCE_FACTOR)
    for engine, (table, other) in PROVIDER_FACTORS.items():
        out = F.when(source == engine, lookup(name, table, other)).otherwise(out)
    return out


def is_fallback_provider(provider: Column) -> Column:
    return F.contains(F.lower(provider), F.lit("fallback"))


def conversion_confidence(condition_type: Column) -> Column:
    return lookup(condition_type, CONVERSION_PRIORS, OTHER_PRIOR)


def is_declarative_friendly(condition: Column) -> Column:
    text = F.lower(strip(F.coalesce(condition, F.lit(""))))
    return text.startswith("missing(") | text.rlike("[<>]|[=!]=")


def effective_confidence(source: Column, provider: Column, overall: Column) -> Column:
    return overall * provider_factor(source, provider)


def sources_of(results: DataFrame, declarative: Mapping[str, bool] | None = None) -> tuple[Source, ...]:
    """The shipped sources in tie order, then any others of the results by name; others are declarative unless said otherwise.

    results holds a row per source and rule, so their names are a handful.
    """
    kinds = dict(declarative or {})
    found = {row.source for row in results.select("source").distinct().collect() if row.source is not None}
    return (tuple(Source(x.name, kinds.get(x.name, x.declarative)) for x in SOURCES)
            + tuple(Source(name, kinds.get(name, True)) for name in sorted(found - set(ENGINES))))


def sources_in(comparison: DataFrame) -> tuple[str, ...]:
    """Names of the sources that a comparison has a struct of."""
    return tuple(f.name for f in comparison.schema if f.dataType.typeName() == "struct" and "decision" in f.dataType.names)


def _names(sources: Sequence[Source], declarative: bool) -> list[str]:
    return [x.name for x in sources if x.declarative == declarative]


def _row(name: str) -> Column:
    return F.col(f"`{name}`")


def decision_score(source: Column, effective: Column, friendly: Column, sources: Sequence[Source] = SOURCES) -> Column:
    """Effective confidence with penalties for mismatches and bonuses for evidence and fit."""
    procedural = source.isin(*_names(sources, False))
    fits = F.when(friendly, source.isin(*_names(sources, True))).otherwise(procedural)
    return (
        effective
        - F.when(F.col("status") != "MATCH", REVIEW_PENALTY).otherwise(0.0)
        - F.col("mismatches")
        + F.when(procedural,
                 F.col("equivalence_match_rate") * EQUIVALENCE_BONUS + F.col("mutation_score") * MUTATION_BONUS
                 - F.when(F.col("equivalence_status") != "PASS", EQUIVALENCE_PENALTY).otherwise(0.0)).otherwise(0.0)
        + F.when(fits, FIT_BONUS).otherwise(0.0)
    )


def score_rows(results: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Adds factor, effective confidence and decision score to rows per source and rule."""
    friendly = F.coalesce(F.col("declarative_friendly"), is_declarative_friendly(F.col("condition")))
    return (
        results.withColumn("declarative_friendly", friendly)
        .withColumn("provider_factor", provider_factor(F.col("source"), F.col("provider")))
        .withColumn("effective", F.col("overall_confidence") * F.col("provider_factor"))
        .withColumn("decision", decision_score(F.col("source"), F.col("effective"), F.col("declarative_friendly"), sources))
    )


ENGINE_FIELDS = (
    "source", "status", "mismatches", "parity_ci_lower", "overall_confidence", "equivalence_match_rate",
    "equivalence_status", "mutation_score", "repair_applied", "provider", "provider_factor", "effective", "decision",
)
RULE_FIELDS = (
    "tag", "severity", "condition", "jurisdiction", "profile_tags", "regulatory_type", "legal_citation", "source_url",
    "effective_date", "review_status", "reviewer", "required_fields", "exemption_logic", "rule_notes",
    "condition_type", "complexity", "declarative_friendly", "products_tested",
)


def line_up(scored: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """One row per rule: its own fields, and a struct per source (null where the source lacks the rule)."""
    names = [x.name for x in sources]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("source"))
    fields = [name for name in RULE_FIELDS if name in scored.columns]
    return scored.where(F.col("source").isNotNull()).groupBy("rule_name").agg(
        F.min_by(F.struct(*fields), F.when(place > 0, place).otherwise(len(names) + 1)).alias("rule"),
        *[F.max_by(F.struct(*ENGINE_FIELDS), F.when(F.col("source") == e, 1)).alias(e) for e in names],
    ).select("rule_name", "rule.*", *[F.when(_row(e)["source"] == e, _row(e)).alias(e) for e in names])


def declarative_choice(rows: Mapping[str, Column], rule_name: Column) -> Column:
    """struct(engine, reason, tied): the best declarative source, an exact tie split by name hash.

    rows: the struct of each declarative source, in tie order.
    """
    def standing(place: int, name: str, row: Column) -> Column:
        return F.when(row.isNotNull(), F.struct(
            F.struct(F.when(row["status"] == "MATCH", 1).otherwise(0).alias("a"), (-row["mismatches"]).alias("b"),
                     row["decision"].alias("c"), row["effective"].alias("d"), row["overall_confidence"].alias("e")).alias("key"),
            F.lit(-place).alias("place"), F.lit(name).alias("engine")))

    def pick(engine: Column, reason: Column, tied: bool) -> Column:
        return F.struct(engine.cast("string").alias("engine"), reason.alias("reason"), F.lit(tied).alias("tied"))

    none = pick(F.lit(None), F.lit("declarative-unavailable"), False)
    if not rows:
        return none
    ranked = F.sort_array(F.array_compact(F.array(*[standing(k, n, r) for k, (n, r) in enumerate(rows.items())])), asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    odd = F.conv(F.right(F.sha1(rule_name), F.lit(1)), 16, 10).cast("int") % 2 == 1
    return (
        F.when(F.size(ranked) == 0, none)
        .when(F.size(ranked) == 1, pick(first["engine"], F.concat(F.lit("only-"), first["engine"], F.lit("-available")), False))
        .when(first["key"] > second["key"],
              pick(first["engine"], F.concat(F.lit("declarative-rank:"), first["engine"], F.lit(">"), second["engine"]), False))
        .when(odd, pick(second["engine"], F.concat(F.lit("explicit-hash-tie-break-odd->"), second["engine"]), True))
        .otherwise(pick(first["engine"], F.concat(F.lit("explicit-hash-tie-break-even->"), first["engine"]), True))
    )


def _of(engine: Column, field: str, names: Sequence[str] = ENGINES) -> Column:
    out = F.lit(None)
    for e in names:
        out = F.when(engine == e, _row(e)[field]).otherwise(out)
    return out


def _top(names: Sequence[str]) -> Column:
    """The source of the highest decision score; ties go to the earlier one."""
    return F.array_max(F.array(*[
        F.when(_row(e).isNotNull(), F.struct(
            _row(e)["decision"].alias("a"), _row(e)["effective"].alias("b"), _row(e)["overall_confidence"].alias("c"),
            F.lit(-i).alias("d"), F.lit(e).alias("engine")))
        for i, e in enumerate(names)]))["engine"] if names else F.lit(None).cast("string")


def best_engine(lined: DataFrame, sources: Sequence[Source] = SOURCES) -> DataFrame:
    """Adds the chosen source, the reason and whether a tie was split."""
    names, declarative, procedural = [x.name for x in sources], _names(sources, True), _names(sources, False)
    rows = (
        lined.withColumn("_top", _top(names)).withColumn("_proc", _top(procedural))
        .withColumn("_decl", declarative_choice({e: _row(e) for e in declarative}, F.col("rule_name")))
    )
    proc, decl, reason, tied = F.col("_proc"), F.col("_decl.engine"), F.col("_decl.reason"), F.col("_decl.tied")
    near = (
        (_of(proc, "status", names) == "MATCH") & decl.isNotNull()
        & (F.abs(_of(proc, "effective", names) - _of(decl, "effective", names)) <= CLOSE)
    )
    near = F.coalesce(near, F.lit(False))
    friendly = F.col("declarative_friendly")

    def out(engine: Column, why: Column, split: Column) -> Column:
        return F.struct(engine.alias("engine"), why.alias("why"), split.alias("split"))

    chosen = (
        F.when(friendly & near, out(decl, F.concat(F.lit("hybrid-close-declarative:"), reason), tied))
        .when(~friendly & near, out(proc, F.concat(F.lit("hybrid-close-procedural:prefer-"), proc), F.lit(False)))
        .when(F.col("_top").isin(*declarative) & tied,
              out(decl, F.concat(F.lit("explicit-declarative-tie:"), reason), F.lit(True)))
        .otherwise(out(F.col("_top"), F.lit("top-decision-score"), F.lit(False)))
    )
    return rows.withColumn("_c", chosen).withColumns({
        "best_engine": F.col("_c.engine"), "selection_reason": F.col("_c.why"),
        "declarative_tie_break_applied": F.col("_c.split")}).drop("_c", "_top", "_proc", "_decl")


def migration_state(best: Column, sources: Sequence[Source] = SOURCES) -> Column:
    """struct(state, reason) by ordered tests on the chosen source's row."""
    def to(state: str, reason: str) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))

    procedural = F.col("best_engine").isin(*_names(sources, False))
    # State texts.
    return (
        F.when((best["status"] != "MATCH") | (best["mismatches"] > 0),
               to("review", "Parity mismatches remain or the rule still needs manual inspection."))
        .when(procedural & (best["equivalence_status"] != "PASS"),
              to("review", "Python conversion has not yet passed equivalence verification."))
        .when(best["parity_ci_lower"] < MIN_PARITY,
              to("review", "Parity evidence is still too weak for acceptance."))
        .when(is_fallback_provider(best["provider"]),
              to("candidate", "Behavior matches, but the current engine/provider is still a fallback path."))
        .when(procedural & (best["mutation_score"] < MIN_MUTATION),
              to("candidate", "Python rule matches, but mutation resistance should be improved before acceptance."))
        .when(best["effective"] < MIN_EFFECTIVE,
              to("candidate", "Rule matches the baseline, but confidence remains too low for final acceptance."))
        .when(F.lower(strip(F.col("review_status"))).isin(*PENDING_LEGAL),
              to("candidate", "Technically validated, but regulatory review is still pending."))
        .otherwise(to("accepted", "Rule meets parity, provider-quality, and verification requirements."))
    )


def rule_recommendation(best: Column, sources: Sequence[Source] = SOURCES) -> Column:
    engine = F.col("best_engine")
    procedural = engine.isin(*_names(sources, False))
    # Advice texts.
    return (
        F.when(best["mismatches"] > 0, F.lit("Needs manual review; parity mismatches exist."))
        .when(is_fallback_provider(best["provider"]),
              F.concat(engine, F.lit(" currently wins, but provider is fallback. "
                                     "Enable real engine execution to confirm this choice.")))
        .when(procedural & (best["equivalence_status"] != "PASS"),
              F.lit("Python rule failed equivalence checks; inspect counterexamples before accepting."))
        .when(engine.isin(*_names(sources, True)) & F.col("declarative_friendly"),
              F.lit("Declarative-friendly rule; prefer dbt/soda for readability and operations."))
        .when(procedural & F.col("complexity").isin("medium", "intricate"),
              F.concat(F.lit("Procedural preference: rule is "), F.col("complexity"), F.lit(" ("),
                       F.col("condition_type"), F.lit("). Python migration is preferred under current evidence.")))
        .when(procedural, F.lit("Keep procedural Python migration path for this rule."))
        .otherwise(F.concat(F.lit("Prefer "), engine, F.lit(" for this rule under current evidence.")))
    )


def rule_comparison(results: DataFrame, sources: Sequence[Source] | None = None) -> DataFrame:
    """The final table: one row per rule with the choice, the state, the advice and a struct per source.

    Without `sources`, those that the results hold are compared, whatever their names and number.
    """
    sources = sources_of(results) if sources is None else tuple(sources)
    chosen = best_engine(line_up(score_rows(results, sources), sources), sources)
    best = F.coalesce(*[F.when(F.col("best_engine") == x.name, _row(x.name)) for x in sources])
    return (
        chosen.withColumn("_best", best)
        .withColumn("recommendation", rule_recommendation(F.col("_best"), sources))
        .withColumn("_state", migration_state(F.col("_best"), sources))
        .withColumns({
            "migration_state": F.col("_state.state"), "migration_state_reason": F.col("_state.reason"),
            "effective_confidence": F.round(F.col("_best.effective"), 4)})
        .drop("_state", "_best")
    )


# ---- summaries (all over one row per rule or source) --------------------------------------

def engine_summary(results: DataFrame) -> DataFrame:
    def mean(name: str) -> Column:
        return F.round(F.avg(name), 4)
    procedural = F.col("source") == "python"
    real = F.count_if(F.lower(strip(F.col("provider"))) == "groq")
    return score_rows(results).groupBy("source").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(F.col("status") == "MATCH").alias("passed"),
        mean("overall_confidence").alias("avg_overall_confidence"),
        mean("effective").alias("avg_effective_confidence"),
        mean("parity_ci_lower").alias("avg_parity_ci_lower"),
        mean("equivalence_match_rate").alias("avg_equivalence_rate"),
        mean("mutation_score").alias("avg_mutation_score"),
        F.count_if(is_fallback_provider(F.col("provider"))).alias("fallback_rules"),
        F.when(F.first(procedural), real).alias("real_conversion_rules"),
        F.when(F.first(procedural), F.round(real / F.count(F.lit(1)), 4)).alias("real_conversion_rate"),
        F.when(F.first(procedural), F.count_if(F.col("repair_applied"))).alias("repairs_applied"),
    )


def _wins(engine: str) -> Column:
    return F.count_if(F.col("best_engine") == engine).alias(f"{engine}_wins")


def complexity_summary(comparison: DataFrame) -> DataFrame:
    tier = F.when(F.col("complexity").isin(*TIERS), F.col("complexity"))
    return comparison.where(tier.isNotNull()).groupBy("complexity").agg(
        F.count(F.lit(1)).alias("rules"), *[_wins(e) for e in sources_in(comparison)],
        F.round(F.avg("effective_confidence"), 4).alias("avg_best_effective_confidence"),
    )


def migration_state_summary(comparison: DataFrame) -> DataFrame:
    """Count per state with zeros; an unknown state counts as review."""
    state = F.lower(F.col("migration_state"))
    folded = comparison.select(F.when(state.isin(*STATES), state).otherwise("review").alias("state"))
    return folded.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES]).selectExpr(
        f"stack({len(STATES)}, " + ", ".join(f"'{s}', {s}" for s in STATES) + ") AS (migration_state, rules)")


def engine_wins(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy(F.col("best_engine").alias("engine")).agg(F.count(F.lit(1)).alias("rules"))


def comparison_kpis(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count(F.lit(1)).alias("rules_compared"), *[_wins(e) for e in sources_in(comparison)],
        F.round(F.avg(percent(F.col("effective_confidence"))), 6).alias("avg_best_effective_pct"),
        F.count_if(F.col("jurisdiction") == "ca").alias("regional_rules"),
    )


def _margin(field: str, names: Sequence[str]) -> Column:
    ordered = F.sort_array(F.array(*[
        F.coalesce(F.round(_row(e)[field], 4), F.lit(0.0)) for e in names]), asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def confidence_margin(comparison: DataFrame) -> DataFrame:
    names = sources_in(comparison)
    return comparison.select(
        "rule_name",
        F.round(_margin("effective", names) * 100, 2).alias("effective_margin_pct"),
        F.round(_margin("decision", names), 4).alias("decision_margin"),
    )


def rule_frame(comparison: DataFrame) -> DataFrame:
    """One wide row per rule for display, with the columns of every source side by side."""
    names = sources_in(comparison)

    def per_engine(suffix: str, make) -> list[Column]:
        return [make(_row(e)).alias(f"{e}_{suffix}") for e in names]

    python = F.col("python")
    return comparison.select(
        "rule_name", "severity", "condition", "condition_type", "complexity", "declarative_friendly", "jurisdiction",
        "regulatory_type", "legal_citation", "review_status", "products_tested", "best_engine", "migration_state",
        "migration_state_reason",
        percent(F.round(_of(F.col("best_engine"), "effective", names), 4)).alias("best_effective_pct"),
        F.round(_margin("effective", names) * 100, 2).alias("effective_margin_pct"),
        F.round(_of(F.col("best_engine"), "decision", names), 4).alias("best_decision_score"),
        F.round(_margin("decision", names), 4).alias("decision_margin"),
        *per_engine("status", lambda r: F.coalesce(r["status"], F.lit("n/a"))),
        *per_engine("effective_pct", lambda r: percent(F.round(r["effective"], 4))),
        *per_engine("decision_score", lambda r: F.coalesce(F.round(r["decision"], 4), F.lit(0.0))),
        *per_engine("overall_pct", lambda r: percent(r["overall_confidence"])),
        percent(F.coalesce(python["equivalence_match_rate"], F.lit(1.0))).alias("python_equivalence_pct"),
        percent(F.coalesce(python["mutation_score"], F.lit(1.0))).alias("python_mutation_pct"),
        percent(F.coalesce(python["equivalence_match_rate"] * python["mutation_score"], F.lit(1.0)))
        .alias("python_verification_pct"),
        F.coalesce(python["repair_applied"], F.lit(False)).alias("python_repair_applied"),
        *per_engine("mismatches", lambda r: F.coalesce(r["mismatches"], F.lit(0))),
        F.coalesce(F.lower(python["provider"]) == "groq", F.lit(False)).alias("python_real_conversion"),
        *per_engine("provider", lambda r: F.coalesce(r["provider"], F.lit(""))),
        "selection_reason", "declarative_tie_break_applied", "recommendation",
    )


def melt_engine_confidence(frame: DataFrame) -> DataFrame:
    """Wide confidence columns to (rule_name, engine, effective_pct)."""
    columns = [c for c in frame.columns if c.endswith("_effective_pct") and c != "best_effective_pct"]
    return frame.unpivot("rule_name", columns, "engine", "effective_pct").withColumn(
        "engine", F.upper(F.regexp_replace("engine", "_effective_pct$", "")))


def engine_detail(results: DataFrame, rule_name: str) -> DataFrame:
    """The sources of one rule as display rows."""
    return score_rows(results.where(F.col("rule_name") == rule_name)).select(
        F.upper("source").alias("engine"), "status",
        percent(F.col("overall_confidence")).alias("overall_confidence_pct"),
        percent(F.round("effective", 4)).alias("effective_confidence_pct"),
        F.round("decision", 4).alias("decision_score"),
        percent(F.col("parity_ci_lower")).alias("parity_ci_low_pct"),
        percent(F.col("equivalence_match_rate")).alias("equivalence_pct"),
        percent(F.col("mutation_score")).alias("mutation_pct"),
        percent(F.round(F.col("equivalence_match_rate") * F.col("mutation_score"), 4)).alias("verification_pct"),
        "mismatches",
        percent(F.round("provider_factor", 4)).alias("provider_factor_pct"),
        "provider",
    )


def filter_jurisdiction(frame: DataFrame, selected: list[str]) -> DataFrame:
    """Rows of the chosen jurisdictions; an empty choice keeps all."""
    return frame.where(F.col("jurisdiction").isin(*selected)) if selected else frame


def rule_frame_order(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("best_effective_pct"), F.asc("rule_name"))
