"""The steps a user calls: compare sources, export a review, check it, apply it, revalidate.

Results that later steps or people need are written as tables under root/<name>/<run_id>; the next
step reads them, so nothing long-lived depends on cached blocks or on recomputing a whole plan.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemill.operators import apply as A
from rulemill.operators import compare as C
from rulemill.operators import feedback as B
from rulemill.operators import fixes as X
from rulemill.operators import issues as I
from rulemill.operators import parity as P
from rulemill.operators import revalidate as V
from rulemill.operators import review as R
from rulemill.operators.evaluate import Pack
from rulemill.rules.catalog import rule_ir
from rulemill.rules.packs import DEFAULT_PROFILE, attach_profile_metadata, select_rules
from rulemill.rules.spec import SHIPPED, Rule, rules_frame
from rulemill.schemas import FEEDBACK_SCHEMA, FIX
from rulemill.session import TABLE_FILES, broadcast_if_small
from rulemill.sources import sheets


class Store:
    """Tables of one run under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/{self.run_id}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.options(**TABLE_FILES).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))


def rule_rows(spark: SparkSession, rules: Sequence[Rule] = SHIPPED) -> DataFrame:
    """Rules with metadata and hash, one row each."""
    return attach_profile_metadata(rule_ir(rules_frame(spark, rules))).drop(
        "operator", "left_operand", "left_operands", "right_field", "threshold", "scale_factor", "offset",
        "right_offset", "clauses", "rule_ir")


def conversions(
    spark: SparkSession, rules: Sequence[Rule], providers: dict[str, str], verification: DataFrame | None = None,
) -> DataFrame:
    """Provider and prior per source and rule, with verification figures per rule where given.

    verification holds (rule_name, equivalence_match_rate, equivalence_status, mutation_score) and counts
    for the procedural source only.
    """
    rows = []
    for source, provider in providers.items():
        for rule in rules:
            if source in C.DECLARATIVE:
                prior = C.DECLARATIVE_FALLBACK_PRIOR if "fallback" in provider else C.DECLARATIVE_PRIOR
            else:
                prior = C.CONVERSION_PRIORS.get(rule.condition_type, C.OTHER_PRIOR)
            rows.append((source, rule.rule_name, provider, prior))
    base = spark.createDataFrame(rows, "source string, rule_name string, provider string, prior double").withColumn(
        "repair_applied", F.lit(False))
    figures = {"equivalence_match_rate": F.lit(1.0), "equivalence_status": F.lit("PASS"), "mutation_score": F.lit(1.0)}
    if verification is None:
        return base.withColumns(figures)
    procedural = [x for x in providers if x not in C.DECLARATIVE]
    known = verification.select("rule_name", F.explode(F.array(*map(F.lit, procedural)).cast("array<string>")).alias("source"), *figures)
    return base.join(F.broadcast(known), ["source", "rule_name"], "left").withColumns(
        {name: F.coalesce(F.col(name), default) for name, default in figures.items()})


@dataclass
class Comparison:
    results: DataFrame
    comparison: DataFrame


def run_parity(
    products: DataFrame, baseline: Pack, candidate: Pack, conversion_rows: DataFrame, rules: Sequence[Rule] = SHIPPED,
    profile: str = DEFAULT_PROFILE,
) -> DataFrame:
    """One candidate against the baseline, with all statistics per rule; both packs share one scan."""
    return run_comparison(products, baseline, [candidate], conversion_rows, rules, profile).results


def run_comparison(
    products: DataFrame, baseline: Pack, candidates: Sequence[Pack], conversion_rows: DataFrame,
    rules: Sequence[Rule] = SHIPPED, profile: str = DEFAULT_PROFILE, store: Store | None = None,
) -> Comparison:
    """All candidates against the baseline in one scan, lined up and decided. The results hold one row per source and rule."""
    chosen = select_rules(rules, profile)
    names = {r.rule_name for r in chosen}

    def keep(pack: Pack) -> Pack:
        return Pack(pack.source, tuple(r for r in pack.rules if r.rule_name in names), pack.blank, pack.sql)

    counts = P.counts_by_source(products, keep(baseline), [keep(p) for p in candidates])
    results = P.rule_result(counts, conversion_rows, rule_rows(products.sparkSession, chosen))
    if store is not None:
        results = store.save("rule_results", results)
    kinds = {p.source: p.sql for p in candidates if p.source not in C.ENGINES}
    comparison = C.rule_comparison(results, (*C.SOURCES, *[C.Source(n, kinds[n]) for n in sorted(kinds)]))
    if store is not None:
        comparison = store.save("rule_comparison", comparison)
        store.save("run_info", P.dataset_fingerprint(products).select(
            F.lit(store.run_id).alias("run_id"), F.lit(profile).alias("profile"), "*"))
    return Comparison(results, comparison)


def empty_feedback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FEEDBACK_SCHEMA)


def export_review(
    products: DataFrame, pack: Pack, comparison: DataFrame, feedback: DataFrame, store: Store,
    max_per_rule: int | None = None,
) -> dict[str, DataFrame]:
    """Issues with ranked fixes, their review sheet, the ranking weights and a frozen copy of the products."""
    spark = products.sparkSession
    frozen = store.save("source", products)
    rules = rule_rows(spark, pack.rules)
    weights = B.feedback_weights(feedback, rules)
    found = I.issues_join(frozen, pack, I.comparison_rules(comparison, rules), max_per_rule)
    made = X.with_ranked_fixes(found, FIX.names, B.weights_by_rule(weights))
    issues = store.save("issues", made.select(*I.ISSUE_COLUMNS, "fix_candidates"))
    sheets.write_review_sheet(X.review_sheet(issues), store.path("review_sheet"))
    return {
        "source": frozen, "issues": issues, "sheet": sheets.scan_review_sheet(spark, store.path("review_sheet")),
        "ranking_weights": store.save("ranking_weights", B.ranking_weights_snapshot(issues, weights)),
        "top_rules": I.top_rules(issues)}


def validate_review(sheet: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, counts) of a reviewed sheet."""
    lacking = sheets.missing_required_columns(sheet)
    checked = R.check_rows(sheets.numbered(sheet) if lacking else sheet, issues)
    found = R.messages(checked)
    if lacking:
        text = f"Missing required columns: {', '.join(lacking)}"
        first = sheet.sparkSession.createDataFrame([("error", 1, text)], "level string, row_idx long, message string")
        found = first.unionByName(found)
    return found, R.validation_counts(checked, len(lacking))


def apply_review(
    sheet: DataFrame, issues: DataFrame, products: DataFrame, feedback: DataFrame, store: Store, timestamp: str,
) -> dict[str, DataFrame]:
    """Check the sheet, refuse it when invalid, then patch the products, log, learn and update the states.

    An id that several issues share names the one of the row's rule and product; the stored decisions keep the longer name.
    """
    shared = broadcast_if_small(store.save("shared_issue_ids", R.shared_ids(issues)))
    sheet, issues = R.tell_apart(sheet, shared), R.tell_apart(issues, shared)
    found, counts = validate_review(sheet, issues)
    counts = store.save("review_validation", counts)
    if not counts.select("valid").head()[0]:
        worst = [row.message for row in found.where("level = 'error'").orderBy("row_idx").limit(3).collect()]
        raise ValueError(f"the reviewed sheet is not valid: {'; '.join(worst)}")
    named = store.save("decisions", R.decisions(sheet, issues))
    decided = R.given_ids(named)
    patches = store.save("patches", A.patch_chain(A.approved_changes(decided), products, small=True))
    corrected = store.save("corrected", A.apply_patches(products, patches, small=True))
    updated = R.given_ids(R.status_update_join(sheet, R.status_updates_applied(named)))
    return {
        "decisions": decided, "patches": patches, "corrected": corrected, "validation": counts,
        "audit": store.save("audit", A.audit_entries(patches, timestamp)),
        "feedback": store.save("feedback", B.feedback_merge(feedback, B.feedback_events(decided), store.run_id)),
        "sheet": store.save("sheet_applied", updated),
        "summary": store.save("apply_summary", A.apply_summary(decided, patches, products))}


def revalidate(
    before: dict[str, DataFrame], corrected: DataFrame, sheet: DataFrame, before_comparison: DataFrame,
    after_comparison: DataFrame, pack: Pack, store: Store,
) -> dict[str, DataFrame]:
    """Issues of the corrected table against those before it, the summary and the final states of applied rows.

    before holds source and issues of the export. Scores divide by the sizes of the run before, so the
    corrected table must hold the same products.
    """
    ids = [P.dataset_fingerprint(df.select("product_id")).head() for df in (before["source"], corrected)]
    if tuple(ids[0]) != tuple(ids[1]):
        raise ValueError("the corrected table does not hold the products of the run before")
    rules = I.comparison_rules(after_comparison)
    after = store.save("issues_after", I.issues_join(corrected, pack, rules).select("issue_id", "rule_name", "product_id"))
    delta = store.save("issue_delta", V.issue_delta(before["issues"], after))
    ids = [issues.select("issue_id", "rule_name", "product_id") for issues in (before["issues"], after)]
    shared = R.shared_ids(ids[0].unionAll(ids[1]))
    named, still = (R.tell_apart(rows, shared) for rows in ids)
    rows = R.tell_apart(sheet, shared)
    return {
        "issues_after": after, "delta": V.rule_change_order(delta),
        "matched": V.matched_delta(named, still),
        "summary": V.revalidation_summary(delta, before_comparison, after_comparison),
        "sheet": R.given_ids(R.status_update_join(rows, R.revalidated_updates(rows, still)))}

