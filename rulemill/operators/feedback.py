"""Reviewer feedback per fix strategy, and the weights that re-rank fixes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemill.operators.fixes import STRATEGY_BONUS

# Weight scales, minimum reviews and the limit of a weight.
GLOBAL_SCALE, GLOBAL_MIN = 0.10, 2
RULE_SCALE, RULE_MIN = 0.24, 1
WEIGHT_LIMIT = 0.22
MANUAL_STRATEGY = "__manual_edit__"
KEYS = ["rule_name", "fix_strategy"]


def feedback_events(decided: DataFrame) -> DataFrame:
    """One row per vote (rule_name, fix_strategy, accepted, rejected).

    The chosen strategy is accepted by an approval and rejected by anything else; an approval also
    rejects the strategies that compete with it; an edit by hand is accepted whatever the action.
    """
    fix, approved = F.col("selected_fix"), F.col("user_action") == "approve"

    def vote(strategy: Column, accepted: Column) -> Column:
        return F.struct(strategy.alias("fix_strategy"), accepted.cast("bigint").alias("accepted"),
                        (~accepted).cast("bigint").alias("rejected"))

    nothing = F.array().cast("array<struct<fix_strategy:string,accepted:bigint,rejected:bigint>>")
    chosen = F.when(fix.isNotNull(), F.array(vote(fix["fix_strategy"], approved))).otherwise(nothing)
    rivals = F.when(fix.isNotNull() & approved, F.transform(
        F.filter("fix_candidates", lambda f: (f["fix_id"] != fix["fix_id"]) & (f["fix_strategy"] != fix["fix_strategy"])),
        lambda f: vote(f["fix_strategy"], F.lit(False)))).otherwise(nothing)
    edits = F.when(F.size("manual_changes") > 0, F.array(vote(F.lit(MANUAL_STRATEGY), F.lit(True)))).otherwise(nothing)
    # put together before they are taken apart, as only then in generated code
    return decided.select("rule_name", F.concat(chosen, rivals, edits).alias("votes")).select(
        "rule_name", F.inline_outer("votes")).where("fix_strategy IS NOT NULL")


def count_votes(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEYS).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def count_choices(choices: DataFrame) -> DataFrame:
    """count_votes of the events of review.vote_choices: equal choices are counted first, and only their counts become votes."""
    counted = choices.groupBy("rule_name", "approved", "edited", "chosen", "rivals").agg(F.count(F.lit(1)).alias("n"))
    nothing, no = F.array().cast("array<struct<fix_strategy:string,accepted:bigint,rejected:bigint>>"), F.lit(0).cast("bigint")

    def vote(strategy: Column, accepted: Column) -> Column:
        return F.struct(strategy.alias("fix_strategy"), F.when(accepted, F.col("n")).otherwise(no).alias("accepted"),
                        F.when(accepted, no).otherwise(F.col("n")).alias("rejected"))

    votes = F.concat(
        F.array(vote(F.col("chosen"), F.col("approved"))),
        F.coalesce(F.transform("rivals", lambda s: vote(s, F.lit(False))), nothing),
        F.when(F.col("edited"), F.array(vote(F.lit(MANUAL_STRATEGY), F.lit(True)))).otherwise(nothing))
    return count_votes(counted.select("rule_name", F.inline(votes)).where("fix_strategy IS NOT NULL"))


def feedback_counts(events: DataFrame) -> DataFrame:
    """Counts per strategy, over all rules (scope global) and per rule, from one pass; only counts are rolled up."""
    per_rule = count_votes(events).rollup("fix_strategy", "rule_name").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"),
        F.grouping("rule_name").alias("g"), F.grouping("fix_strategy").alias("all"))
    return per_rule.where("all = 0").select(
        F.when(F.col("g") == 1, "global").otherwise("rule").alias("scope"), "rule_name", "fix_strategy", "accepted",
        "rejected")


def feedback_merge(store: DataFrame, events: DataFrame, batch_id: str) -> DataFrame:
    """The store with a batch added. Rows are keyed by batch: a batch that is already there changes nothing."""
    batch = count_votes(events).select(F.lit(batch_id).alias("batch_id"), *KEYS, "accepted", "rejected")
    seen = store.where(F.col("batch_id") == batch_id).select("batch_id").limit(1)
    return store.select(*batch.columns).unionByName(batch.join(F.broadcast(seen), "batch_id", "left_anti"))


def stats_weight(accepted: Column, rejected: Column, scale: float, min_reviews: int) -> Column:
    total = accepted + rejected
    return F.coalesce(F.when(
        total >= min_reviews, F.try_divide((accepted - rejected).cast("double"), total.cast("double")) * scale), F.lit(0.0))


def feedback_weights(store: DataFrame, rules: DataFrame) -> DataFrame:
    """Non-zero weights per rule and strategy, for every rule given; strategies are a fixed short list."""
    names = F.array(*map(F.lit, STRATEGY_BONUS))
    pairs = rules.select("rule_name", F.explode(names).alias("fix_strategy"))
    per_rule = store.groupBy(*KEYS).agg(F.sum("accepted").alias("ra"), F.sum("rejected").alias("rr"))
    overall = store.groupBy("fix_strategy").agg(F.sum("accepted").alias("ga"), F.sum("rejected").alias("gr"))
    joined = pairs.join(F.broadcast(per_rule), KEYS, "left").join(F.broadcast(overall), "fix_strategy", "left")
    total = (stats_weight(F.col("ga"), F.col("gr"), GLOBAL_SCALE, GLOBAL_MIN)
             + stats_weight(F.col("ra"), F.col("rr"), RULE_SCALE, RULE_MIN))
    clamped = F.greatest(F.least(total, F.lit(WEIGHT_LIMIT)), F.lit(-WEIGHT_LIMIT))
    return joined.select(*KEYS, F.round(clamped, 4).alias("weight")).where("weight <> 0")


def weight_maps(weights: DataFrame) -> DataFrame:
    """One map of weights per rule, never larger than the list of strategies."""
    return weights.groupBy("rule_name").agg(
        F.map_from_entries(F.collect_list(F.struct("fix_strategy", "weight"))).alias("weights"))


def weights_by_rule(weights: DataFrame) -> dict[str, dict[str, float]]:
    """The weights of every rule, at most one row per rule and strategy, for with_ranked_fixes."""
    found: dict[str, dict[str, float]] = {}
    for row in weights.collect():
        found.setdefault(row.rule_name, {})[row.fix_strategy] = row.weight
    return found


def weights_by_rule(weights: DataFrame) -> dict[str, dict[str, float]]:
    """The weights of every rule, at most one row per rule and strategy, for with_ranked_fixes."""
    found: dict[str, dict[str, float]] = {}
    for row in weights.collect():
        found.setdefault(row.rule_name, {})[row.fix_strategy] = row.weight
    return found


def attach_weights(issues: DataFrame, weights: DataFrame) -> DataFrame:
    """Issues with the weights of their rule, for rank_fixes."""
    return issues.join(F.broadcast(weight_maps(weights)), "rule_name", "left")


def ranking_weights_snapshot(issues: DataFrame, weights: DataFrame) -> DataFrame:
    """Per issue the weights of the strategies it offers."""
    offered = F.col("fix_candidates.fix_strategy")
    kept = F.map_filter(F.coalesce("weights", F.create_map().cast("map<string,double>")),
                        lambda k, v: F.array_contains(offered, k))
    return attach_weights(issues, weights).select("issue_id", "rule_name", kept.alias("weights"))


def feedback_summary(store: DataFrame) -> DataFrame:
    return store.agg(
        F.coalesce(F.sum("accepted") + F.sum("rejected"), F.lit(0)).alias("votes"),
        F.count_distinct("rule_name").alias("tracked_rules"), F.count_distinct("fix_strategy").alias("tracked_strategies"))


def flatten_feedback(store: DataFrame) -> DataFrame:
    """Global and per-rule rows with the net preference."""
    return feedback_counts(store).withColumn("net_preference", F.col("accepted") - F.col("rejected"))


def feedback_frames_order(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("net_preference"), F.desc("accepted"), "scope", "rule_name", "fix_strategy")


def top_strategies(store: DataFrame, limit: int = 5) -> DataFrame:
    """The strategies reviewers like best over all rules; edits by hand do not count."""
    rows = flatten_feedback(store).where((F.col("scope") == "global") & (F.col("fix_strategy") != MANUAL_STRATEGY))
    return rows.orderBy(F.desc("net_preference"), F.desc("accepted"), "fix_strategy").limit(limit).select(
        "fix_strategy", "accepted", "rejected")
