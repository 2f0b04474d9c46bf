"""Parity, statistics, comparison and governance."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.operators import compare as C
from rulemill.operators import evaluate as E
from rulemill.operators import parity as P
from rulemill.registry import query
from rulemill.registry.adapter import P_CTE, products
from rulemill.registry.core import BASE, C_CTE, CANDIDATE
from rulemill.registry.rule_sql import V_CTE
from rulemill.rules.packs import REGIONAL_RULES, attach_profile_metadata
from rulemill.rules.spec import SHIPPED, rules_frame
from rulemill.schemas import NUMBER_COLUMNS, PRODUCT_COLUMNS

FLAGS_CTE = """u AS (
  SELECT rule_name, product_id, max(b) = 1 AS in_baseline, max(c) = 1 AS in_candidate FROM (
    SELECT rule_name, product_id, 1 AS b, 0 AS c FROM v UNION ALL SELECT rule_name, product_id, 0, 1 FROM c) x
  GROUP BY rule_name, product_id)"""
WITH_FLAGS = f"WITH {P_CTE}, {V_CTE}, {C_CTE}, {FLAGS_CTE}"


def both(spark, sf_dir):
    p = products(spark, sf_dir)
    return E.rule_verdicts(p, BASE), E.rule_verdicts(p, CANDIDATE)


def flags(spark, sf_dir):
    return P.verdict_flags(*both(spark, sf_dir))


@query("parity_full_outer", f"{WITH_FLAGS} SELECT * FROM u")
def parity_full_outer(spark, sf_dir):
    return flags(spark, sf_dir)


@query("parity_mismatch_ids", f"{WITH_FLAGS} SELECT * FROM u WHERE in_baseline <> in_candidate")
def parity_mismatch_ids(spark, sf_dir):
    return P.mismatches(flags(spark, sf_dir))


_SAMPLE_SQL = """SELECT rule_name, product_id, in_baseline, in_candidate, CAST(r AS INTEGER) AS row_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY product_id) AS r FROM u
  WHERE in_baseline <> in_candidate) WHERE r <= 10"""


@query("mismatch_sample_per_rule", f"{WITH_FLAGS} {_SAMPLE_SQL}")
def mismatch_sample_per_rule(spark, sf_dir):
    return P.mismatch_sample(flags(spark, sf_dir))


_CASES_SQL = f"""{WITH_FLAGS}, s AS ({_SAMPLE_SQL})
SELECT s.rule_name, s.in_baseline, s.in_candidate, s.row_rank, product_id, {', '.join(P.CASE_COLUMNS)}
FROM s JOIN p USING (product_id)"""


@query("failed_case_rows", _CASES_SQL)
def failed_case_rows(spark, sf_dir):
    return P.failed_case_rows(flags(spark, sf_dir), products(spark, sf_dir))


@query("failed_case_rows_one_scan", _CASES_SQL)
def failed_case_rows_one_scan(spark, sf_dir):
    return P.failed_cases_one_scan(products(spark, sf_dir), BASE, CANDIDATE)


@query("supporting_union", f"{WITH_FLAGS} SELECT rule_name, product_id FROM u")
def supporting_union(spark, sf_dir):
    return P.supporting_union(*both(spark, sf_dir))


@query("positive_intersection", f"{WITH_FLAGS} SELECT rule_name, product_id FROM u WHERE in_baseline AND in_candidate")
def positive_intersection(spark, sf_dir):
    return P.positive_intersection(*both(spark, sf_dir))


@query("mismatch_except", f"{WITH_FLAGS} SELECT rule_name, product_id FROM u WHERE in_baseline <> in_candidate")
def mismatch_except(spark, sf_dir):
    return P.mismatch_except(*both(spark, sf_dir))


def counts_cte(sources: dict[str, str]) -> str:
    """k: counts per source and rule; sources maps a name to the verdict CTE of that source."""
    branches = " UNION ALL ".join(
        f"SELECT '{s}' AS source, rule_name, product_id, 1 AS b, 0 AS c FROM v"
        f" UNION ALL SELECT '{s}', rule_name, product_id, 0, 1 FROM {cte}" for s, cte in sources.items())
    return f"""t AS (SELECT count(*) AS n FROM p),
  w AS (SELECT source, rule_name, product_id, max(b) AS b, max(c) AS c FROM ({branches}) x
        GROUP BY source, rule_name, product_id),
  k AS (SELECT source, rule_name, n AS products_tested, n - count(CASE WHEN b <> c THEN 1 END) AS matches,
          count(CASE WHEN b = 1 THEN 1 END) AS baseline_errors, count(CASE WHEN c = 1 THEN 1 END) AS candidate_errors, count(*) AS supporting_violations,
          count(CASE WHEN b = 1 AND c = 1 THEN 1 END) AS positive_matches, count(CASE WHEN b <> c THEN 1 END) AS mismatches
        FROM w, t GROUP BY source, rule_name, n)"""


_ONE = f"WITH {P_CTE}, {V_CTE}, {C_CTE}, {counts_cte({'candidate': 'c'})}"


def one_candidate(spark, sf_dir):
    return P.counts_by_source(products(spark, sf_dir), BASE, [CANDIDATE])


@query("parity_counts", f"{_ONE} SELECT * FROM k")
def parity_counts(spark, sf_dir):
    return one_candidate(spark, sf_dir)


@query("parity_counts_from_verdicts", f"{_ONE} SELECT * EXCLUDE (source) FROM k")
def parity_counts_from_verdicts(spark, sf_dir):
    return P.count_flags(flags(spark, sf_dir), products(spark, sf_dir), rules_frame(spark, SHIPPED))


@query("parity_rates", f"""{_ONE}
SELECT rule_name, CAST(matches AS DOUBLE)/products_tested AS confidence,
  CAST(supporting_violations AS DOUBLE)/products_tested AS positive_coverage,
  CASE WHEN supporting_violations > 0 THEN CAST(positive_matches AS DOUBLE)/supporting_violations ELSE 0.5 END
    AS positive_agreement FROM k""")
def parity_rates(spark, sf_dir):
    return P.add_rates(one_candidate(spark, sf_dir)).select(
        "rule_name", "confidence", "positive_coverage", "positive_agreement")


def wilson_sql(x: str, n: str, side: str) -> str:
    z = "CAST(1.96 AS DOUBLE)"
    p, zz = f"(CAST({x} AS DOUBLE)/{n})", f"({z}*{z})"
    centre = f"(({p} + {zz}/(2*{n}))/(1+{zz}/{n}))"
    half = f"({z}*sqrt(({p}*(1-{p}) + {zz}/(4*{n}))/{n})/(1+{zz}/{n}))"
    return f"greatest(0, {centre}-{half})" if side == "lower" else f"least(1, {centre}+{half})"


@query("wilson_interval", f"""{_ONE} SELECT rule_name,
  round({wilson_sql('matches', 'products_tested', 'lower')}, 9) AS parity_ci_lower,
  round({wilson_sql('matches', 'products_tested', 'upper')}, 9) AS parity_ci_upper,
  round({wilson_sql('supporting_violations', 'products_tested', 'lower')}, 9) AS coverage_ci_lower,
  round({wilson_sql('supporting_violations', 'products_tested', 'upper')}, 9) AS coverage_ci_upper FROM k""")
def wilson_interval(spark, sf_dir):
    names = ["parity_ci_lower", "parity_ci_upper", "coverage_ci_lower", "coverage_ci_upper"]
    return P.add_wilson(one_candidate(spark, sf_dir)).select(
        "rule_name", *[F.round(n, 9).alias(n) for n in names])


def beta_sql(p: str, m: str = "positive_matches", s: str = "supporting_violations") -> str:
    """The quantile by bisection on the binomial tail, which equals the beta distribution at whole counts."""
    x = "((a.lo+a.hi)/2)"
    tail = (f"list_sum(list_transform(range({m}+1, {s}+2), lambda j: exp(lgamma({s}+2)-lgamma(j+1)-lgamma({s}+2-j)"
            f" + j*ln({x}) + ({s}+1-j)*ln(1-{x}))))")
    start = "list_transform(range(60), lambda i: {'lo': CAST(0 AS DOUBLE), 'hi': CAST(1 AS DOUBLE)})"
    return (f"list_reduce({start}, lambda a, i: CASE WHEN {tail} < {p} THEN {{'lo': {x}, 'hi': a.hi}}"
            f" ELSE {{'lo': a.lo, 'hi': {x}}} END).lo")


@query("beta_credible_bounds", f"""{_ONE} SELECT rule_name, round({beta_sql('0.05')}, 6) AS evidence_ci_lower,
  round({beta_sql('0.95')}, 6) AS evidence_ci_upper FROM k""")
def beta_credible_bounds(spark, sf_dir):
    rows = P.add_beta(P.add_posterior(one_candidate(spark, sf_dir)))
    return rows.select("rule_name", *[F.round(n, 6).alias(n) for n in ("evidence_ci_lower", "evidence_ci_upper")])


@query("evidence_posterior", f"""{_ONE} SELECT rule_name, positive_matches + CAST(1 AS DOUBLE) AS evidence_alpha,
  supporting_violations - positive_matches + CAST(1 AS DOUBLE) AS evidence_beta,
  (positive_matches + CAST(1 AS DOUBLE)) / (supporting_violations + 2) AS evidence_posterior_mean FROM k""")
def evidence_posterior(spark, sf_dir):
    return P.add_posterior(one_candidate(spark, sf_dir)).select(
        "rule_name", "evidence_alpha", "evidence_beta", "evidence_posterior_mean")


# ---- three sources, with providers and verification figures that vary by rule ---------------

_CONVERSION_COLUMNS = (
    "source string, rule_name string, provider string, prior double, equivalence_match_rate double,"
    " equivalence_status string, mutation_score double, repair_applied boolean")


def conversion_rows() -> list[tuple]:
    rows = []
    for i, r in enumerate(SHIPPED):
        failed = i % 7 == 3
        rows.append(("python", r.rule_name, "groq" if i % 3 == 0 else "simulated_fallback",
                     C.CONVERSION_PRIORS[r.condition_type], 0.9 if failed else 1.0, "FAIL" if failed else "PASS",
                     0.5 if i % 5 == 1 else 1.0, i % 6 == 0))
        dbt, soda = i % 2 == 0, i % 4 < 2
        rows.append(("dbt", r.rule_name, "dbt_core" if dbt else "dbt_core_sql_fallback",
                     C.DECLARATIVE_PRIOR if dbt else C.DECLARATIVE_FALLBACK_PRIOR, 1.0, "PASS", 1.0, False))
        rows.append(("soda", r.rule_name, "soda_cloud" if soda else "soda_core_sql_fallback",
                     C.DECLARATIVE_PRIOR if soda else C.DECLARATIVE_FALLBACK_PRIOR, 1.0, "PASS", 1.0, False))
    return rows


def conversions(spark):
    return spark.createDataFrame(conversion_rows(), _CONVERSION_COLUMNS)


def rule_metadata(spark):
    return attach_profile_metadata(rules_frame(spark, SHIPPED)).drop("operator", "left_operand", "left_operands",
                                                                     "right_field", "threshold", "scale_factor",
                                                                     "offset", "right_offset", "clauses")


def results(spark, sf_dir):
    packs = [E.Pack("python", CANDIDATE.rules, CANDIDATE.blank), E.sql_pack("dbt"), E.sql_pack("soda")]
    counts = P.counts_by_source(products(spark, sf_dir), BASE, packs)
    return P.rule_result(counts, conversions(spark), rule_metadata(spark))


def _literal(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else f"'{x}'"


_META_SQL = ", ".join(
    "(" + ", ".join(map(_literal, (
        r.rule_name, r.tag, r.severity, r.complexity, r.declarative_friendly, r.condition_type, r.condition,
        "ca" if r.rule_name in REGIONAL_RULES else "global",
        "draft" if r.rule_name in REGIONAL_RULES else "reviewed"))) + ")" for r in SHIPPED)
RESULTS_CTE = f"""{P_CTE}, {V_CTE}, {C_CTE}, {counts_cte({'python': 'c', 'dbt': 'v', 'soda': 'v'})},
  conv(source, rule_name, provider, prior, equivalence_match_rate, equivalence_status, mutation_score, repair_applied)
    AS (VALUES {', '.join('(' + ', '.join(map(_literal, row)) + ')' for row in conversion_rows())}),
  meta(rule_name, tag, severity, complexity, declarative_friendly, condition_type, condition, jurisdiction, review_status)
    AS (VALUES {_META_SQL}),
  st AS (SELECT *, {wilson_sql('matches', 'products_tested', 'lower')} AS pl,
           {beta_sql('0.05')} AS el, {beta_sql('0.95')} AS eu FROM k),
  rr AS (SELECT st.*, conv.* EXCLUDE (source, rule_name), meta.* EXCLUDE (rule_name),
           round(pl, 4) AS parity_ci_lower, round(el, 4) AS evidence_ci_lower, round(eu, 4) AS evidence_ci_upper,
           round(prior * pl * el, 4) AS overall_confidence,
           CASE WHEN mismatches = 0 THEN 'MATCH' ELSE 'REVIEW' END AS status
         FROM st JOIN conv USING (source, rule_name) JOIN meta USING (rule_name))"""
WITH_RESULTS = f"WITH {RESULTS_CTE}"


@query("overall_confidence", f"{WITH_RESULTS} SELECT source, rule_name, overall_confidence, status FROM rr")
def overall_confidence(spark, sf_dir):
    return results(spark, sf_dir).select("source", "rule_name", "overall_confidence", "status")


@query("rule_result", f"""{WITH_RESULTS} SELECT source, rule_name, tag, severity, condition, condition_type, complexity,
  declarative_friendly, jurisdiction, review_status, products_tested, baseline_errors, candidate_errors,
  supporting_violations, positive_matches, matches, mismatches,
  round(CAST(matches AS DOUBLE)/products_tested, 4) AS confidence,
  round(CAST(positive_matches AS DOUBLE)/supporting_violations, 4) AS positive_agreement,
  round(CAST(supporting_violations AS DOUBLE)/products_tested, 4) AS positive_coverage,
  parity_ci_lower, round({wilson_sql('matches', 'products_tested', 'upper')}, 4) AS parity_ci_upper,
  round({wilson_sql('supporting_violations', 'products_tested', 'lower')}, 4) AS coverage_ci_lower,
  round({wilson_sql('supporting_violations', 'products_tested', 'upper')}, 4) AS coverage_ci_upper,
  round((positive_matches + CAST(1 AS DOUBLE)) / (supporting_violations + 2), 4) AS evidence_posterior_mean,
  evidence_ci_lower, evidence_ci_upper, prior, overall_confidence, status, provider FROM rr""")
def rule_result(spark, sf_dir):
    return results(spark, sf_dir).select(
        "source", "rule_name", "tag", "severity", "condition", "condition_type", "complexity", "declarative_friendly",
        "jurisdiction", "review_status", "products_tested", "baseline_errors", "candidate_errors",
        "supporting_violations", "positive_matches", "matches", "mismatches", "confidence", "positive_agreement",
        "positive_coverage", "parity_ci_lower", "parity_ci_upper", "coverage_ci_lower", "coverage_ci_upper",
        "evidence_posterior_mean", "evidence_ci_lower", "evidence_ci_upper", "prior", "overall_confidence", "status",
        "provider")


@query("migration_summary", f"""{WITH_RESULTS} SELECT source, count(*) AS total_rules,
  count(CASE WHEN status = 'MATCH' THEN 1 END) AS passed_rules, count(*) - count(CASE WHEN status = 'MATCH' THEN 1 END) AS rules_needing_review,
  round(avg(overall_confidence), 4) AS average_overall_confidence FROM rr GROUP BY source""")
def migration_summary(spark, sf_dir):
    return P.migration_summary(results(spark, sf_dir))


_FACTOR_SQL = """CASE
  WHEN source = 'python' THEN CASE provider WHEN 'groq' THEN 1.0 WHEN 'simulated_fallback' THEN 0.55 ELSE 0.75 END
  WHEN source = 'dbt' THEN CASE provider WHEN 'dbt_core' THEN 1.0 WHEN 'dbt_core_sql_fallback' THEN 0.85 ELSE 0.9 END
  WHEN source = 'soda' THEN CASE WHEN provider IN ('soda_cloud', 'soda_core') THEN 1.0
    WHEN provider = 'soda_core_sql_fallback' THEN 0.85 ELSE 0.9 END ELSE 0.8 END"""
SCORED_CTE = f"""{RESULTS_CTE},
  sf AS (SELECT *, CAST({_FACTOR_SQL} AS DOUBLE) AS factor FROM rr),
  sc AS (SELECT *, overall_confidence * factor AS eff,
    overall_confidence * factor - CASE WHEN status <> 'MATCH' THEN CAST(0.25 AS DOUBLE) ELSE 0 END - mismatches
    + CASE WHEN source = 'python' THEN equivalence_match_rate * CAST(0.05 AS DOUBLE)
        + mutation_score * CAST(0.05 AS DOUBLE)
        - CASE WHEN equivalence_status <> 'PASS' THEN CAST(0.1 AS DOUBLE) ELSE 0 END ELSE 0 END
    + CASE WHEN declarative_friendly = (source <> 'python') THEN CAST(0.035 AS DOUBLE) ELSE 0 END AS dec FROM sf)"""
WITH_SCORED = f"WITH {SCORED_CTE}"


@query("provider_factor", f"{WITH_SCORED} SELECT source, rule_name, provider, factor AS provider_factor FROM sc")
def provider_factor(spark, sf_dir):
    return C.score_rows(results(spark, sf_dir)).select("source", "rule_name", "provider", "provider_factor")


@query("is_fallback_provider", f"""{WITH_RESULTS} SELECT source, rule_name,
  strpos(lower(provider), 'fallback') > 0 AS is_fallback FROM rr""")
def is_fallback_provider(spark, sf_dir):
    return results(spark, sf_dir).select(
        "source", "rule_name", C.is_fallback_provider(F.col("provider")).alias("is_fallback"))


@query("conversion_confidence", f"""{_ONE}, meta(rule_name, condition_type) AS (
  VALUES {', '.join(f"('{r.rule_name}', '{r.condition_type}')" for r in SHIPPED)})
SELECT rule_name, candidate_errors, CAST(CASE condition_type WHEN 'field_comparison' THEN 0.98
  WHEN 'field_threshold' THEN 0.96 WHEN 'missing_field' THEN 0.93 WHEN 'sum_fields_comparison' THEN 0.91
  WHEN 'compound_threshold_and' THEN 0.9 WHEN 'affine_field_comparison' THEN 0.89
  WHEN 'scaled_field_comparison' THEN 0.88 ELSE 0.8 END AS DOUBLE) AS prior FROM k JOIN meta USING (rule_name)""")
def conversion_confidence(spark, sf_dir):
    rules = F.broadcast(rules_frame(spark, SHIPPED).select("rule_name", "condition_type"))
    return one_candidate(spark, sf_dir).join(rules, "rule_name").select(
        "rule_name", "candidate_errors", C.conversion_confidence(F.col("condition_type")).alias("prior"))


@query("effective_confidence", f"""{WITH_SCORED}
SELECT source, rule_name, round(eff, 6) AS effective_confidence FROM sc""")
def effective_confidence(spark, sf_dir):
    return C.score_rows(results(spark, sf_dir)).select(
        "source", "rule_name", F.round("effective", 6).alias("effective_confidence"))


@query("decision_score", f"{WITH_SCORED} SELECT source, rule_name, round(dec, 6) AS decision_score FROM sc")
def decision_score(spark, sf_dir):
    return C.score_rows(results(spark, sf_dir)).select(
        "source", "rule_name", F.round("decision", 6).alias("decision_score"))


def _pivot(e: str) -> str:
    names = ("status", "mismatches", "parity_ci_lower", "overall_confidence", "equivalence_match_rate",
             "equivalence_status", "mutation_score", "repair_applied", "provider", "eff", "dec")
    return ", ".join(f"max(CASE WHEN source = '{e}' THEN {n} END) AS {e}_{n}" for n in names)


_RULE_COLS = ("tag, severity, condition, condition_type, complexity, declarative_friendly, jurisdiction,"
              " review_status, products_tested")


def _tuple(e: str) -> str:
    return (f"row(CASE WHEN {e}_status = 'MATCH' THEN 1 ELSE 0 END, -{e}_mismatches, {e}_dec, {e}_eff,"
            f" {e}_overall_confidence)")


def _by(engine: str, field: str) -> str:
    return f"CASE {engine} " + " ".join(f"WHEN '{e}' THEN {e}_{field}" for e in C.ENGINES) + " END"


BEST_CTE = f"""{SCORED_CTE},
  pv AS (SELECT rule_name, {', '.join(f'any_value({c}) AS {c}' for c in _RULE_COLS.split(', '))},
           {', '.join(_pivot(e) for e in C.ENGINES)} FROM sc GROUP BY rule_name),
  hx AS (SELECT *, strpos('13579bdf', right(sha1(rule_name), 1)) > 0 AS odd,
           CASE WHEN {_tuple('dbt')} > {_tuple('soda')} THEN 'gt' WHEN {_tuple('dbt')} < {_tuple('soda')} THEN 'lt'
             ELSE 'eq' END AS cmp FROM pv),
  dc AS (SELECT *, CASE cmp WHEN 'gt' THEN 'dbt' WHEN 'lt' THEN 'soda' ELSE CASE WHEN odd THEN 'soda' ELSE 'dbt' END END
             AS decl,
           CASE cmp WHEN 'gt' THEN 'declarative-rank:dbt>soda' WHEN 'lt' THEN 'declarative-rank:soda>dbt'
             ELSE CASE WHEN odd THEN 'explicit-hash-tie-break-odd->soda' ELSE 'explicit-hash-tie-break-even->dbt' END
             END AS decl_reason, cmp = 'eq' AS tied,
           CASE WHEN row(python_dec, python_eff, python_overall_confidence) >= row(dbt_dec, dbt_eff, dbt_overall_confidence)
                 AND row(python_dec, python_eff, python_overall_confidence)
                   >= row(soda_dec, soda_eff, soda_overall_confidence) THEN 'python'
                WHEN row(dbt_dec, dbt_eff, dbt_overall_confidence) >= row(soda_dec, soda_eff, soda_overall_confidence)
                  THEN 'dbt' ELSE 'soda' END AS top FROM hx),
  nr AS (SELECT *, python_status = 'MATCH' AND abs(python_eff - {_by('decl', 'eff')}) <= CAST(0.2 AS DOUBLE) AS near
         FROM dc),
  be AS (SELECT *, CASE WHEN near AND declarative_friendly THEN decl WHEN near THEN 'python'
             WHEN top <> 'python' AND tied THEN decl ELSE top END AS best_engine,
           CASE WHEN near AND declarative_friendly THEN 'hybrid-close-declarative:' || decl_reason
             WHEN near THEN 'hybrid-close-procedural:prefer-python'
             WHEN top <> 'python' AND tied THEN 'explicit-declarative-tie:' || decl_reason
             ELSE 'top-decision-score' END AS selection_reason,
           CASE WHEN near THEN declarative_friendly AND tied ELSE top <> 'python' AND tied END
             AS declarative_tie_break_applied FROM nr)"""
WITH_BEST = f"WITH {BEST_CTE}"


@query("rule_comparison_join", f"""{WITH_SCORED}
SELECT rule_name, {', '.join(f"max(CASE WHEN source = '{e}' THEN status END) AS {e}_status,"
                             f" max(CASE WHEN source = '{e}' THEN mismatches END) AS {e}_mismatches"
                             for e in C.ENGINES)}
FROM sc GROUP BY rule_name""")
def rule_comparison_join(spark, sf_dir):
    lined = C.line_up(C.score_rows(results(spark, sf_dir)))
    return lined.select("rule_name", *[
        F.col(f"{e}.{f}").alias(f"{e}_{f}") for e in C.ENGINES for f in ("status", "mismatches")])


@query("rule_name_union", f"""WITH {P_CTE}, {V_CTE}, {C_CTE}
SELECT DISTINCT rule_name FROM (SELECT rule_name FROM v UNION ALL SELECT rule_name FROM c) x""")
def rule_name_union(spark, sf_dir):
    left, right = both(spark, sf_dir)
    return left.select("rule_name").union(right.select("rule_name")).distinct().orderBy("rule_name")


@query("best_engine", f"""{WITH_BEST} SELECT rule_name, best_engine, selection_reason,
  declarative_tie_break_applied FROM be""")
def best_engine(spark, sf_dir):
    return C.best_engine(C.line_up(C.score_rows(results(spark, sf_dir)))).select(
        "rule_name", "best_engine", "selection_reason", "declarative_tie_break_applied")


@query("declarative_tie_break", f"""{WITH_BEST}
SELECT rule_name, decl AS engine, decl_reason AS reason, tied FROM dc""")
def declarative_tie_break(spark, sf_dir):
    lined = C.line_up(C.score_rows(results(spark, sf_dir)))
    return lined.select("rule_name", C.declarative_choice(
        {e: F.col(e) for e in C.DECLARATIVE}, F.col("rule_name")).alias("c")).select("rule_name", "c.*")


_STATE_SQL = f"""CASE
  WHEN {_by('best_engine', 'status')} <> 'MATCH' THEN 1
  WHEN best_engine = 'python' AND python_equivalence_status <> 'PASS' THEN 2
  WHEN {_by('best_engine', 'parity_ci_lower')} < 0.95 THEN 3
  WHEN strpos({_by('best_engine', 'provider')}, 'fallback') > 0 THEN 4
  WHEN best_engine = 'python' AND python_mutation_score < 0.6 THEN 5
  WHEN {_by('best_engine', 'eff')} < 0.1 THEN 6
  WHEN review_status = 'draft' THEN 7 ELSE 8 END"""
_REASONS = (
    "Parity mismatches remain or the rule still needs manual inspection.",
    "Python conversion has not yet passed equivalence verification.",
    "Parity evidence is still too weak for acceptance.",
    "Behavior matches, but the current engine/provider is still a fallback path.",
    "Python rule matches, but mutation resistance should be improved before acceptance.",
    "Rule matches the baseline, but confidence remains too low for final acceptance.",
    "Technically validated, but regulatory review is still pending.",
    "Rule meets parity, provider-quality, and verification requirements.",
)
FINAL_CTE = f"""{BEST_CTE},
  fs AS (SELECT *, {_STATE_SQL} AS step, {_by('best_engine', 'eff')} AS best_eff,
           {_by('best_engine', 'dec')} AS best_dec FROM be),
  fc AS (SELECT *, CASE WHEN step <= 3 THEN 'review' WHEN step <= 7 THEN 'candidate' ELSE 'accepted' END
             AS migration_state,
           CASE step {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_REASONS, 1))} END
             AS migration_state_reason,
           round(best_eff, 4) AS effective_confidence,
           CASE WHEN {_by('best_engine', 'mismatches')} > 0 THEN 'Needs manual review; parity mismatches exist.'
             WHEN strpos({_by('best_engine', 'provider')}, 'fallback') > 0 THEN best_engine ||
               ' currently wins, but provider is fallback. Enable real engine execution to confirm this choice.'
             WHEN best_engine = 'python' AND python_equivalence_status <> 'PASS' THEN
               'Python rule failed equivalence checks; inspect counterexamples before accepting.'
             WHEN best_engine <> 'python' AND declarative_friendly THEN
               'Declarative-friendly rule; prefer dbt/soda for readability and operations.'
             WHEN best_engine = 'python' AND complexity IN ('medium', 'intricate') THEN
               'Procedural preference: rule is ' || complexity || ' (' || condition_type ||
               '). Python migration is preferred under current evidence.'
             WHEN best_engine = 'python' THEN 'Keep procedural Python migration path for this rule.'
             ELSE 'Prefer ' || best_engine || ' for this rule under current evidence.' END AS recommendation FROM fs)"""
WITH_FINAL = f"WITH {FINAL_CTE}"


def comparison(spark, sf_dir):
    return C.rule_comparison(results(spark, sf_dir))


@query("migration_state", f"{WITH_FINAL} SELECT rule_name, migration_state, migration_state_reason FROM fc")
def migration_state(spark, sf_dir):
    return comparison(spark, sf_dir).select("rule_name", "migration_state", "migration_state_reason")


@query("rule_recommendation", f"{WITH_FINAL} SELECT rule_name, recommendation FROM fc")
def rule_recommendation(spark, sf_dir):
    return comparison(spark, sf_dir).select("rule_name", "recommendation")


_COMPARISON_COLUMNS = (
    "rule_name, tag, severity, condition, condition_type, complexity, declarative_friendly, jurisdiction,"
    " review_status, products_tested, best_engine, selection_reason, declarative_tie_break_applied, recommendation,"
    " migration_state, migration_state_reason, effective_confidence")


@query("rule_comparison", f"{WITH_FINAL} SELECT {_COMPARISON_COLUMNS} FROM fc")
def rule_comparison(spark, sf_dir):
    return comparison(spark, sf_dir).select(*_COMPARISON_COLUMNS.split(", "))


@query("engine_summary", f"""{WITH_SCORED} SELECT source, count(*) AS rules, count(CASE WHEN status = 'MATCH' THEN 1 END) AS passed,
  round(avg(overall_confidence), 4) AS avg_overall_confidence, round(avg(eff), 4) AS avg_effective_confidence,
  round(avg(parity_ci_lower), 4) AS avg_parity_ci_lower, round(avg(equivalence_match_rate), 4) AS avg_equivalence_rate,
  round(avg(mutation_score), 4) AS avg_mutation_score,
  count(CASE WHEN strpos(provider, 'fallback') > 0 THEN 1 END) AS fallback_rules,
  CASE WHEN source = 'python' THEN count(CASE WHEN provider = 'groq' THEN 1 END) END AS real_conversion_rules,
  CASE WHEN source = 'python' THEN round(CAST(count(CASE WHEN provider = 'groq' THEN 1 END) AS DOUBLE)/count(*), 4) END
    AS real_conversion_rate,
  CASE WHEN source = 'python' THEN count(CASE WHEN repair_applied THEN 1 END) END AS repairs_applied FROM sc GROUP BY source""")
def engine_summary(spark, sf_dir):
    return C.engine_summary(results(spark, sf_dir))


_WINS_SQL = ", ".join(f"count(CASE WHEN best_engine = '{e}' THEN 1 END) AS {e}_wins" for e in C.ENGINES)


@query("complexity_summary", f"""{WITH_FINAL} SELECT complexity, count(*) AS rules, {_WINS_SQL},
  round(avg(effective_confidence), 4) AS avg_best_effective_confidence FROM fc GROUP BY complexity""")
def complexity_summary(spark, sf_dir):
    return C.complexity_summary(comparison(spark, sf_dir))


@query("migration_state_summary", f"""{WITH_FINAL}
SELECT s.state AS migration_state, count(fc.rule_name) AS rules
FROM (VALUES ('accepted'), ('candidate'), ('review')) s(state) LEFT JOIN fc ON fc.migration_state = s.state
GROUP BY s.state""")
def migration_state_summary(spark, sf_dir):
    return C.migration_state_summary(comparison(spark, sf_dir))


@query("engine_wins", f"{WITH_FINAL} SELECT best_engine AS engine, count(*) AS rules FROM fc GROUP BY best_engine")
def engine_wins(spark, sf_dir):
    return C.engine_wins(comparison(spark, sf_dir))


@query("comparison_kpis", f"""{WITH_FINAL} SELECT count(*) AS rules_compared, {_WINS_SQL},
  round(avg(round(effective_confidence * 100, 2)), 6) AS avg_best_effective_pct,
  count(CASE WHEN jurisdiction = 'ca' THEN 1 END) AS regional_rules FROM fc""")
def comparison_kpis(spark, sf_dir):
    return C.comparison_kpis(comparison(spark, sf_dir))


def _margin_sql(field: str) -> str:
    items = ", ".join(f"round({e}_{field}, 4)" for e in C.ENGINES)
    ordered = f"list_sort([{items}], 'DESC')"
    return f"({ordered}[1] - {ordered}[2])"


@query("confidence_margin", f"""{WITH_FINAL} SELECT rule_name, round({_margin_sql('eff')} * 100, 2) AS effective_margin_pct,
  round({_margin_sql('dec')}, 4) AS decision_margin FROM fc""")
def confidence_margin(spark, sf_dir):
    return C.confidence_margin(comparison(spark, sf_dir))


def _each(text: str) -> str:
    return ", ".join(text.replace("@", e) for e in C.ENGINES)


FRAME_SQL = f"""SELECT rule_name, severity, condition, condition_type, complexity, declarative_friendly, jurisdiction,
  review_status, products_tested, best_engine, migration_state, migration_state_reason,
  round(effective_confidence * 100, 2) AS best_effective_pct,
  round({_margin_sql('eff')} * 100, 2) AS effective_margin_pct, round(best_dec, 4) AS best_decision_score,
  round({_margin_sql('dec')}, 4) AS decision_margin,
  {_each('@_status')}, {_each('round(round(@_eff, 4) * 100, 2) AS @_effective_pct')},
  {_each('round(@_dec, 4) AS @_decision_score')}, {_each('round(@_overall_confidence * 100, 2) AS @_overall_pct')},
  round(python_equivalence_match_rate * 100, 2) AS python_equivalence_pct,
  round(python_mutation_score * 100, 2) AS python_mutation_pct,
  round(python_equivalence_match_rate * python_mutation_score * 100, 2) AS python_verification_pct,
  python_repair_applied, {_each('@_mismatches')}, python_provider = 'groq' AS python_real_conversion,
  {_each('@_provider')}, selection_reason, declarative_tie_break_applied, recommendation FROM fc"""
_DROPPED = ("regulatory_type", "legal_citation")  # their texts are checked by attach_profile_metadata


@query("pivot_rule_frame", f"{WITH_FINAL} {FRAME_SQL}")
def pivot_rule_frame(spark, sf_dir):
    return C.rule_frame(comparison(spark, sf_dir)).drop(*_DROPPED)


@query("rule_frame_order", f"""{WITH_FINAL}, fr AS ({FRAME_SQL})
SELECT rule_name, best_effective_pct, row_number() OVER (ORDER BY best_effective_pct DESC, rule_name) AS position FROM fr""")
def rule_frame_order(spark, sf_dir):
    from pyspark.sql import Window

    # one row per rule; the position makes the order visible to an order-free check
    frame = C.rule_frame_order(C.rule_frame(comparison(spark, sf_dir)))
    order = Window.orderBy(F.desc("best_effective_pct"), "rule_name")
    return frame.select("rule_name", "best_effective_pct",
                        F.row_number().over(order).cast("bigint").alias("position"))


@query("melt_engine_confidence", f"""{WITH_FINAL}, fr AS ({FRAME_SQL})
SELECT rule_name, 'PYTHON' AS engine, python_effective_pct AS effective_pct FROM fr
UNION ALL SELECT rule_name, 'DBT', dbt_effective_pct FROM fr UNION ALL SELECT rule_name, 'SODA', soda_effective_pct FROM fr""")
def melt_engine_confidence(spark, sf_dir):
    return C.melt_engine_confidence(C.rule_frame(comparison(spark, sf_dir)))


@query("engine_detail", f"""{WITH_SCORED} SELECT upper(source) AS engine, status,
  round(overall_confidence * 100, 2) AS overall_confidence_pct, round(round(eff, 4) * 100, 2) AS effective_confidence_pct,
  round(dec, 4) AS decision_score, round(parity_ci_lower * 100, 2) AS parity_ci_low_pct,
  round(equivalence_match_rate * 100, 2) AS equivalence_pct, round(mutation_score * 100, 2) AS mutation_pct,
  round(equivalence_match_rate * mutation_score * 100, 2) AS verification_pct, mismatches,
  round(factor * 100, 2) AS provider_factor_pct, provider FROM sc WHERE rule_name = 'energy_kj_over_3911'""")
def engine_detail(spark, sf_dir):
    return C.engine_detail(results(spark, sf_dir), "energy_kj_over_3911")


@query("filter_jurisdiction", f"""{WITH_FINAL} SELECT rule_name, jurisdiction, best_engine FROM fc
WHERE jurisdiction IN ('ca')""")
def filter_jurisdiction(spark, sf_dir):
    return C.filter_jurisdiction(comparison(spark, sf_dir), ["ca"]).select("rule_name", "jurisdiction", "best_engine")


@query("is_declarative_friendly", f"""{WITH_RESULTS} SELECT source, rule_name,
  lower(condition) LIKE 'missing(%' OR regexp_matches(condition, '[<>]|==|!=') AS friendly FROM rr""")
def is_declarative_friendly(spark, sf_dir):
    return results(spark, sf_dir).select(
        "source", "rule_name", C.is_declarative_friendly(F.col("condition")).alias("friendly"))


@query("percent_projection", f"""WITH {P_CTE}
SELECT product_id, round(sodium / 3 * 100, 2) AS sodium_pct, round(coalesce(energy_kj, 0) * 100, 2) AS kj_pct FROM p""")
def percent_projection(spark, sf_dir):
    from rulemill.functions.text import percent

    return products(spark, sf_dir).select(
        "product_id", percent(F.col("sodium") / 3).alias("sodium_pct"), percent(F.col("energy_kj")).alias("kj_pct"))


def _number_sql(c: str) -> str:
    """A double as its whole 53-bit mantissa and a power of two, by exact steps only."""
    size = f"abs({c})"
    moved = f"(CASE WHEN {size} < pow(2.0, -500) THEN 600 WHEN {size} > pow(2.0, 500) THEN -600 ELSE 0 END)"
    near = f"({size} * pow(2.0::DOUBLE, {moved}))"
    guess = f"CAST(floor(log2({near})) AS INTEGER)"
    lead = f"({near} * pow(2.0::DOUBLE, -{guess}))"
    power = f"({guess} + CASE WHEN {lead} >= 2 THEN 1 WHEN {lead} < 1 THEN -1 ELSE 0 END)"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN isnan({c}) THEN 'nan' WHEN isinf({c}) THEN CASE WHEN {c} > 0 THEN 'inf' ELSE '-inf' END "
            f"WHEN {c} = 0 THEN '0' ELSE CASE WHEN {c} < 0 THEN '-' ELSE '' END || "
            f"CAST(CAST({near} * pow(2.0::DOUBLE, 52 - {power}) AS BIGINT) AS VARCHAR) || 'p' || CAST({power} - {moved} - 52 AS VARCHAR) END")


_TEXTS_SQL = ", ".join(f"{_number_sql(c)} AS {c}" if c in NUMBER_COLUMNS else f"CAST({c} AS VARCHAR) AS {c}" for c in PRODUCT_COLUMNS)
_ROW_SQL = " || '|' || ".join(f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '~')" for c in sorted(PRODUCT_COLUMNS))


@query("dataset_fingerprint", f"""WITH {P_CTE}, t AS (SELECT {_TEXTS_SQL} FROM p),
h AS (SELECT product_id, sha256({_ROW_SQL}) AS digest FROM t)
SELECT count(*) AS products_tested, min(product_id) AS product_id_first, max(product_id) AS product_id_last,
  CAST(sum(CAST('0x' || substr(digest, 1, 15) AS HUGEINT)) AS VARCHAR) || '-'
    || CAST(sum(CAST('0x' || substr(digest, 16, 15) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM h""")
def dataset_fingerprint(spark, sf_dir):
    return P.dataset_fingerprint(products(spark, sf_dir))


@query("fingerprint_consistency", f"""{WITH_RESULTS}, f AS (
  SELECT source, CAST(sum(candidate_errors) AS VARCHAR) AS d, CAST(count(*) AS VARCHAR) AS r FROM rr GROUP BY source)
SELECT count(DISTINCT d) <= 1 AS dataset_consistent, count(DISTINCT r) <= 1 AS rulepack_consistent,
  min(d) AS dataset_hash, min(r) AS rulepack_hash, 'mixed_or_unknown' AS commit FROM f""")
def fingerprint_consistency(spark, sf_dir):
    per_source = results(spark, sf_dir).groupBy("source").agg(
        F.sum("candidate_errors").cast("string").alias("dataset_hash"),
        F.count(F.lit(1)).cast("string").alias("rulepack_hash")).withColumn("commit", F.lit("unknown"))
    return P.fingerprint_consistency(per_source)
