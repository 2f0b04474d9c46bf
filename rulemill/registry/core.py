"""Rules, predicates, counts, samples, tags and verdicts."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.functions import predicates as P
from rulemill.functions.text import blank_spaces_sql
from rulemill.operators import evaluate as E
from rulemill.registry import query
from rulemill.registry.adapter import P_CTE, products
from rulemill.registry.rule_sql import RULE_SQL, V_CTE
from rulemill.rules.spec import SHIPPED, SHIPPED_BY_NAME, rules_frame

BASE = E.Pack("baseline")


def _rule_query(name: str):
    @query(f"rule_{name}", f"WITH {P_CTE} SELECT product_id FROM p WHERE {RULE_SQL[name]}")
    def run(spark, sf_dir):
        return products(spark, sf_dir).where(SHIPPED_BY_NAME[name].predicate()).select("product_id")


for _name in RULE_SQL:
    _rule_query(_name)


def _pred_query(name: str, predicate, sql: str):
    @query(name, f"WITH {P_CTE} SELECT product_id FROM p WHERE {sql}")
    def run(spark, sf_dir):
        return products(spark, sf_dir).where(predicate()).select("product_id")


_pred_query("pred_field_comparison", lambda: P.field_comparison(F.col("sugars"), ">=", F.col("fat")), "sugars >= fat")
_pred_query("pred_field_threshold", lambda: P.field_threshold(F.col("sodium"), "<=", 0.3),
            "sodium <= CAST(0.3 AS DOUBLE)")
_pred_query("pred_missing_field", lambda: P.missing_field(F.col("language_code")),
            "language_code IS NULL OR trim(language_code) = ''")
_pred_query("pred_scaled_comparison", lambda: P.scaled_comparison(F.col("saturated_fat"), ">", F.col("fat"), 0.9),
            "saturated_fat > fat * CAST(0.9 AS DOUBLE)")
_pred_query("pred_affine_comparison",
            lambda: P.affine_comparison(F.col("energy_kj"), "!=", F.col("energy_kcal"), 4.184, 0.0),
            "energy_kj <> CAST(4.184 AS DOUBLE) * energy_kcal + 0")
_pred_query("pred_sum_comparison",
            lambda: P.sum_comparison(F.col("sugars"), F.col("starch"), "<", F.col("carbohydrates"), -5.0),
            "sugars + starch < carbohydrates - 5")
_pred_query("pred_compound_and",
            lambda: P.compound_and([(F.col("fop_symbol_present"), "==", 0.0), (F.col("sodium"), ">", 1.0)]),
            "fop_symbol_present = 0 AND sodium > 1")


@query("count_rows", "SELECT count(*) AS row_count FROM lineitem")
def count_rows(spark, sf_dir):
    return products(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count"))


@query("count_violations",
       f"WITH {P_CTE}, {V_CTE} SELECT rule_name, count(*) AS violations FROM v GROUP BY rule_name")
def count_violations(spark, sf_dir):
    return E.count_violations(products(spark, sf_dir), BASE)


_SAMPLE_COLUMNS = "product_id, energy_kj, energy_kcal, fat, saturated_fat, carbohydrates, sugars, starch, lc, lang"


@query("sample_violations", f"""WITH {P_CTE}, {V_CTE}
SELECT rule_name, {_SAMPLE_COLUMNS}, CAST(r AS INTEGER) AS row_rank FROM (
  SELECT v.rule_name, p.*, row_number() OVER (PARTITION BY v.rule_name ORDER BY p.product_id) AS r
  FROM v JOIN p USING (product_id)) WHERE r <= 5""")
def sample_violations(spark, sf_dir):
    return E.sample_violations(products(spark, sf_dir), BASE).select(
        "rule_name", *_SAMPLE_COLUMNS.split(", "), "row_rank")


@query("violating_ids", f"WITH {P_CTE}, {V_CTE} SELECT rule_name, product_id FROM v")
def violating_ids(spark, sf_dir):
    return E.rule_verdicts(products(spark, sf_dir), E.sql_pack("sql")).select("rule_name", "product_id")


@query("rule_violation_rows", f"""WITH {P_CTE}, {V_CTE}
SELECT v.rule_name, p.* FROM v JOIN p USING (product_id)""")
def rule_violation_rows(spark, sf_dir):
    return E.violation_rows(products(spark, sf_dir), E.sql_pack("sql"))


_TAG = {r.rule_name: r.tag for r in SHIPPED}
_TAG_LIST = ", ".join(f"CASE WHEN {RULE_SQL[n]} THEN '{_TAG[n]}' END" for n in _TAG)
_TAGS_SQL = f"""WITH {P_CTE}
SELECT product_id, concat_ws(',', {_TAG_LIST}) AS tags FROM p"""


@query("product_tags", _TAGS_SQL)
def product_tags(spark, sf_dir):
    return E.product_tags(products(spark, sf_dir), BASE).select(
        "product_id", F.array_join("tags", ",").alias("tags"))


@query("rule_verdicts", f"WITH {P_CTE}, {V_CTE} SELECT 'baseline' AS source, rule_name, product_id FROM v")
def rule_verdicts(spark, sf_dir):
    return E.rule_verdicts(products(spark, sf_dir), BASE)


# A candidate that is wrong on purpose in five rules, so that parity has something to find.
_CHANGED = {
    "energy_kj_over_3911": {"threshold": 4200.0},
    "energy_kj_mismatch_low": {"factor": 3.6},
    "saturated_fat_vs_fat": {"operator": ">=", "offset": 2.0},
    "fat_over_105g": {"threshold": 100.0},
    "carbohydrates_over_105g": {"threshold": 50.0},
}
CANDIDATE_RULES = tuple(r.with_(**_CHANGED.get(r.rule_name, {})) for r in SHIPPED)
CANDIDATE_SQL = {
    **RULE_SQL,
    "energy_kj_over_3911": "energy_kj > 4200",
    "energy_kj_mismatch_low": "energy_kj < CAST(3.6 AS DOUBLE)*energy_kcal - 2",
    "saturated_fat_vs_fat": "saturated_fat >= fat + 2",
    "fat_over_105g": "fat > 100",
    "carbohydrates_over_105g": "carbohydrates > 50",
}
CANDIDATE = E.Pack("candidate", CANDIDATE_RULES, blank_spaces_sql)
C_CTE = "c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS rule_name, product_id FROM p WHERE {s}" for n, s in CANDIDATE_SQL.items()) + ")"


@query("candidate_verdicts",
       f"WITH {P_CTE}, {C_CTE} SELECT 'candidate' AS source, rule_name, product_id FROM c")
def candidate_verdicts(spark, sf_dir):
    return E.rule_verdicts(products(spark, sf_dir), CANDIDATE)


@query("sql_verdicts", f"WITH {P_CTE}, {V_CTE} SELECT 'sql' AS source, rule_name, product_id FROM v")
def sql_verdicts(spark, sf_dir):
    return E.rule_verdicts(products(spark, sf_dir), E.sql_pack("sql"))


@query("tags_from_verdicts", _TAGS_SQL)
def tags_from_verdicts(spark, sf_dir):
    p = products(spark, sf_dir)
    tags = E.tags_from_verdicts(E.rule_verdicts(p, BASE), p, rules_frame(spark, SHIPPED))
    return tags.select("product_id", F.array_join("tags", ",").alias("tags"))


_USER_CHECKS = {
    "sodium_high": lambda d: d["sodium"] >= 1.2,
    "fat_without_carbohydrates": lambda d: d["fat"] > 3 * d["carbohydrates"],
}


@query("rule_pack_as_udf", f"""WITH {P_CTE}
SELECT 'user' AS source, 'sodium_high' AS rule_name, product_id FROM p WHERE sodium >= CAST(1.2 AS DOUBLE)
UNION ALL
SELECT 'user' AS source, 'fat_without_carbohydrates' AS rule_name, product_id FROM p WHERE fat > 3*carbohydrates""")
def rule_pack_as_udf(spark, sf_dir):
    return E.verdicts_from_functions(
        products(spark, sf_dir), _USER_CHECKS, "user", ["sodium", "fat", "carbohydrates"])
