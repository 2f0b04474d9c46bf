"""Compare verdict sources per rule: joins, counts and interval statistics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulemill.functions.hashing import row_number_hash, row_sums, row_texts
from rulemill.functions.stats import beta_bounds, ratio, wilson_bounds
from rulemill.operators.evaluate import WORD, Pack, hits, signature_word, text_literal
from rulemill.operators.ranking import first_n_per_key
from rulemill.schemas import PRODUCT_COLUMNS

KEY = ["rule_name", "product_id"]
CASE_COLUMNS = [name for name in PRODUCT_COLUMNS if name not in ("product_id", "ingredients_text")]


def verdict_flags(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Full outer match on (rule, product) with a flag per side.

    A union and one aggregate: sides need no sort, repeats vanish, and the key is as fine
    as the data, so a rule that flags a third of all products still spreads out.
    """
    both = baseline.select(*KEY, F.lit(1).alias("b"), F.lit(0).alias("c")).unionAll(
        candidate.select(*KEY, F.lit(0).alias("b"), F.lit(1).alias("c")))
    return both.groupBy(*KEY).agg(
        (F.max("b") == 1).alias("in_baseline"), (F.max("c") == 1).alias("in_candidate"))


def mismatches(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("in_baseline") != F.col("in_candidate"))


def mismatch_sample(flags: DataFrame, limit: int = 10) -> DataFrame:
    return first_n_per_key(mismatches(flags), ["rule_name"], [F.col("product_id")], limit, ["product_id"])


def failed_case_rows(flags: DataFrame, products: DataFrame, limit: int = 10) -> DataFrame:
    """The first mismatches of every rule with their product columns; at most limit rows per rule are broadcast."""
    sample = mismatch_sample(flags, limit)
    return products.select("product_id", *CASE_COLUMNS).join(F.broadcast(sample), "product_id")


def failed_cases_one_scan(products: DataFrame, baseline: Pack, candidate: Pack, limit: int = 10) -> DataFrame:
    """The same from the products alone: both packs are evaluated in the scan that carries the columns."""
    left, right = baseline.predicates(), candidate.predicates()
    shared = [n for n in left if n in right]
    only_left = [(f"{n}\n+", f"{left[n]} AND NOT {right[n]}") for n in shared]
    only_right = [(f"{n}\n-", f"{right[n]} AND NOT {left[n]}") for n in shared]
    columns = ["product_id", *CASE_COLUMNS]
    rows = products.selectExpr(*columns, f"explode({hits(only_left + only_right)}) AS hit").selectExpr(
        *columns, "split_part(hit, '\\n', 1) AS rule_name", "hit LIKE '%+' AS in_baseline",
        "hit LIKE '%-' AS in_candidate")
    return first_n_per_key(rows, ["rule_name"], [F.col("product_id")], limit, ["product_id"])


def supporting_union(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return baseline.select(*KEY).union(candidate.select(*KEY)).distinct()


def positive_intersection(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return baseline.select(*KEY).intersect(candidate.select(*KEY))


def mismatch_except(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """The symmetric difference: one pass over both sides instead of two anti joins."""
    return mismatches(verdict_flags(baseline, candidate)).select(*KEY)


# ---- counts -------------------------------------------------------------------------------

COUNTS = ("baseline_errors", "candidate_errors", "supporting_violations", "positive_matches", "mismatches")


def _count_columns(base: Column, cand: Column, weight: Column) -> list[Column]:
    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0)).cast("bigint")
    return [total(cond).alias(name) for name, cond in zip(COUNTS, (base, cand, base | cand, base & cand, base != cand))]


def _with_matches(counts: DataFrame) -> DataFrame:
    return counts.withColumn("matches", F.col("products_tested") - F.col("mismatches"))


def count_flags(flags: DataFrame, products: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts per rule from matched verdicts; rules without any verdict keep zeros. Product ids are unique."""
    per_rule = flags.groupBy("rule_name").agg(
        *_count_columns(F.col("in_baseline"), F.col("in_candidate"), F.lit(1)))
    tested = products.agg(F.count("product_id").alias("products_tested")).withColumn("_one", F.lit(1))
    full = rules.select("rule_name").withColumn("_one", F.lit(1)).join(per_rule, "rule_name", "left")
    return _with_matches(
        full.join(F.broadcast(tested), "_one").drop("_one").fillna(0, list(COUNTS)))


def pattern_counts(products: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """How often each combination of sources flags each rule, from one scan for all packs.

    Every product is reduced to its signature, one bit per rule in a long per pack, and equal
    signatures are counted before the shuffle; the rules are taken apart only after that. Product
    ids must be unique. Columns: rule_name, mask (bit i set when pack i flags), n, products_tested.
    """
    names = list(dict.fromkeys(r.rule_name for pack in packs for r in pack.rules))
    words = [names[at:at + WORD] for at in range(0, len(names), WORD)]
    preds = [pack.predicates() for pack in packs]
    signature = [
        f"{signature_word([by_name.get(name) for name in word])} AS s{bit}_{w}"
        for w, word in enumerate(words) for bit, by_name in enumerate(preds)]
    columns = [f"s{bit}_{w}" for w in range(len(words)) for bit in range(len(preds))]
    counted = products.selectExpr(*signature).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))

    def mask(position: int) -> str:
        w, at = divmod(position, WORD)
        return " + ".join(f"shiftleft(shiftright(s{bit}_{w}, {at}) & 1L, {bit})" for bit in range(len(preds)))

    # the unnamed entry is carried by every product, so that the total comes from the same scan
    entries = ["struct(CAST(NULL AS STRING) AS rule_name, 1L AS mask)"]
    entries += [f"struct({text_literal(name)} AS rule_name, {mask(i)} AS mask)" for i, name in enumerate(names)]
    spread = (
        counted.selectExpr(f"inline(array({', '.join(entries)}))", "n").where("mask > 0")
        .groupBy("rule_name", "mask").agg(F.sum("n").alias("n"))
    )
    everything = Window.partitionBy()  # over at most rules x 2^packs rows
    tested = F.coalesce(F.max(F.when(F.col("rule_name").isNull(), F.col("n"))).over(everything), F.lit(0))
    return spread.withColumn("products_tested", tested).where(F.col("rule_name").isNotNull())


def counts_by_source(products: DataFrame, baseline: Pack, candidates: Sequence[Pack]) -> DataFrame:
    """Counts per (source, rule) of every candidate against the baseline, from one scan."""
    patterns = pattern_counts(products, [baseline, *candidates])
    sources = F.array(*[
        F.struct(F.lit(pack.source).alias("source"), F.lit(2 ** (i + 1)).alias("bit"))
        for i, pack in enumerate(candidates)])
    spread = patterns.withColumn("s", F.explode(sources))
    base = F.col("mask").bitwiseAND(F.lit(1)) > 0
    cand = F.col("mask").bitwiseAND(F.col("s.bit")) > 0
    counted = spread.groupBy(F.col("s.source").alias("source"), "rule_name").agg(
        F.max("products_tested").alias("products_tested"), *_count_columns(base, cand, F.col("n")))
    # rules that nobody violates
    spark = products.sparkSession
    listed = [(pack.source, r.rule_name) for pack in candidates for r in pack.rules]
    full = spark.createDataFrame(listed, "source string, rule_name string")
    whole = F.max("products_tested").over(Window.partitionBy())
    return _with_matches(
        full.join(counted, ["source", "rule_name"], "left")
        .withColumn("products_tested", F.coalesce(whole, F.lit(0)))
        .fillna(0, list(COUNTS)))


# ---- statistics ---------------------------------------------------------------------------

def add_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "confidence": ratio(F.col("matches"), F.col("products_tested"), 1.0),
        "positive_coverage": ratio(F.col("supporting_violations"), F.col("products_tested"), 0.0),
        "positive_agreement": ratio(F.col("positive_matches"), F.col("supporting_violations"), 0.5),
    })


def add_wilson(counts: DataFrame) -> DataFrame:
    parity = wilson_bounds(F.col("matches"), F.col("products_tested"))
    coverage = wilson_bounds(F.col("supporting_violations"), F.col("products_tested"))
    return counts.withColumns({
        "parity_ci_lower": parity[0], "parity_ci_upper": parity[1],
        "coverage_ci_lower": coverage[0], "coverage_ci_upper": coverage[1],
    })


def add_posterior(counts: DataFrame) -> DataFrame:
    alpha = F.col("positive_matches") + F.lit(1.0)
    beta = F.col("supporting_violations") - F.col("positive_matches") + F.lit(1.0)
    return counts.withColumns({
        "evidence_alpha": alpha, "evidence_beta": beta, "evidence_posterior_mean": alpha / (alpha + beta)})


def add_beta(counts: DataFrame) -> DataFrame:
    """Needs the posterior. One row per rule and source reaches Python."""
    bounds = counts.withColumn("_b", beta_bounds(F.col("evidence_alpha"), F.col("evidence_beta")))
    return bounds.withColumns({
        "evidence_ci_lower": F.col("_b.lower"), "evidence_ci_upper": F.col("_b.upper")}).drop("_b")


def add_overall(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "overall_confidence": F.col("prior") * F.col("parity_ci_lower") * F.col("evidence_ci_lower"),
        "status": F.when(F.col("mismatches") == 0, "MATCH").otherwise("REVIEW"),
    })


ROUNDED = (
    "confidence", "positive_agreement", "positive_coverage", "parity_ci_lower", "parity_ci_upper",
    "coverage_ci_lower", "coverage_ci_upper", "evidence_posterior_mean", "evidence_ci_lower",
    "evidence_ci_upper", "overall_confidence",
)


def rule_result(counts: DataFrame, conversions: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per source and rule with all statistics, rounded to four decimals.

    conversions holds (source, rule_name, provider, prior, equivalence_match_rate, equivalence_status,
    mutation_score, repair_applied); rules holds the rule columns and metadata. Both have one row per
    rule and source.
    """
    joined = counts.join(F.broadcast(conversions), ["source", "rule_name"]).join(F.broadcast(rules), "rule_name")
    full = add_overall(add_beta(add_posterior(add_wilson(add_rates(joined)))))
    return full.withColumns({name: F.round(F.col(name), 4) for name in ROUNDED})


def migration_summary(results: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("status") == "MATCH")
    return results.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_rules"),
        passed.alias("passed_rules"),
        (F.count(F.lit(1)) - passed).alias("rules_needing_review"),
        F.round(F.coalesce(F.avg("overall_confidence"), F.lit(0.0)), 4).alias("average_overall_confidence"),
    )


# ---- fingerprints -------------------------------------------------------------------------

def dataset_fingerprint(products: DataFrame) -> DataFrame:
    """Order-free fingerprint of all columns: row count, first and last id and the sums of the row hashes."""
    texts, row = row_texts(products)
    return texts.agg(
        F.count(F.lit(1)).alias("products_tested"),
        F.min("product_id").alias("product_id_first"),
        F.max("product_id").alias("product_id_last"),
        row_sums(row).alias("fingerprint"),
    )


def rulepack_fingerprint(rules: DataFrame) -> DataFrame:
    """Order-free fingerprints of the rule names and of the rule hashes: sums of row hashes, so no task holds a list."""
    def digest(name: str) -> Column:
        return F.sum(row_number_hash(F.col(name)).cast("decimal(28,0)")).cast("string")
    return rules.agg(
        F.count(F.lit(1)).alias("rule_count"),
        digest("rule_name").alias("rule_names_fingerprint"),
        digest("rule_ir_hash").alias("rule_ir_fingerprint"),
    )


def fingerprint_consistency(fingerprints: DataFrame) -> DataFrame:
    """(source, dataset_hash, rulepack_hash, commit) to one row: does everybody see the same data and rules?"""
    def distinct(name: str) -> Column:
        return F.count_distinct(F.nullif(F.col(name), F.lit("")))
    def first(name: str) -> Column:
        return F.coalesce(F.min(F.nullif(F.col(name), F.lit(""))), F.lit(""))
    known = F.when(~F.col("commit").isin("", "unknown"), F.col("commit"))
    return fingerprints.agg(
        (distinct("dataset_hash") <= 1).alias("dataset_consistent"),
        (distinct("rulepack_hash") <= 1).alias("rulepack_consistent"),
        first("dataset_hash").alias("dataset_hash"),
        first("rulepack_hash").alias("rulepack_hash"),
        F.when(F.count_distinct(known) == 1, F.min(known)).otherwise("mixed_or_unknown").alias("commit"),
    )
