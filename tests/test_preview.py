"""Previews without old values need no current values, and fixes ranked by their templates are those ranked by row."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.operators import feedback as B
from rulemill.operators import fixes as X
from rulemill.operators import issues as I
from rulemill.operators import review as R
from rulemill.registry import QUERIES
from rulemill.registry import all_queries  # noqa: F401  (fills QUERIES)
from rulemill.registry import review_queries
from rulemill.schemas import PRODUCT_COLUMNS, column_type

NUMBERS = ("energy_kj", "energy_kj_computed", "energy_kcal", "fat", "saturated_fat", "carbohydrates", "sugars", "starch")
RULES = (*[name for name in X.FIXES if name != "over_limit"], "fat_over_105g", "saturated_fat_over_105g",
         "energy_kj_mismatch_low", "energy_kj_computed_mismatch_high", "no_such_rule", None)


def _issues(spark):
    """Every family under each severity and condition type, with blank and missing values."""
    products = [(*[1.5 + i for i in range(8)], "en", "fr", "de"), (*[None] * 8, "", "", ""), (*[1e20] * 8, None, " ", None),
                (*[float("nan")] * 8, "en", None, "")]
    columns = ", ".join([f"{c} double" for c in NUMBERS] + [f"{c} string" for c in ("lc", "lang", "language_code")])
    rows = [(f"i{rule}", rule, severity, kind, *product) for rule in RULES for product in products
            for severity, kind in (("error", "missing_field"), ("error", "other"), ("warning", "missing_field"), (None, None))]
    return spark.createDataFrame(rows, f"issue_id string, rule_name string, severity string, condition_type string, {columns}").coalesce(1)


def test_fixes_ranked_by_templates_are_those_ranked_by_row(spark):
    issues = _issues(spark)
    for members in (("fix_id",), tuple(n for n in X.FIX.names if n not in ("rank", "ranking_reason"))):
        plain = X.rank_fixes(X.with_fixes(issues, members), members)
        quick = X.with_ranked_fixes(issues, members)
        assert quick.columns == plain.columns
        assert sorted(map(str, quick.collect())) == sorted(map(str, plain.collect()))
    assert "sort_array" not in X.with_ranked_fixes(issues)._jdf.queryExecution().optimizedPlan().toString()


def test_a_repeated_fix_id_names_the_first_and_old_values_stay(spark, tmp_path):
    fix = "array<struct<fix_id:string,target_field:string,new_value:struct<kind:string,value:string>,fix_strategy:string>>"
    rows = [("a", "p", "r", {"fat": "1", "lc": None}, [("x", "fat", ("int", "2"), "s"), ("x", "lc", ("string", "d"), "t")]),
            ("b", "p", "r", {"fat": "1"}, [("x", "", ("string", ""), "s"), ("x", "fat", ("int", "2"), "t"), ("y", None, None, "u")]),
            ("c", None, None, None, None), ("d", "p", "r", {}, [None, (None, "fat", None, None)])]
    spark.createDataFrame(rows, f"issue_id string, product_id string, rule_name string, current_values map<string,string>, "
                                f"fix_candidates {fix}").write.parquet(str(tmp_path / "i"))
    cells = [(i, f, "yes", e, "") for i in "abcd" for f in ("x", "y", "") for e in ("", "fat=9;lc=q", "bad")]
    sheet = spark.createDataFrame(cells, "issue_id string, selected_fix_id string, user_action string, manual_edit string, issue_status string")
    preview = R.patch_preview(sheet, spark.read.parquet(str(tmp_path / "i")))
    assert preview.columns == ["issue_id", "product_id", "rule_name", "source", "field", "old_value", "new_value", "fix_strategy"]
    got = [tuple(r)[3:] for r in preview.where("issue_id = 'a'").collect()]
    edits = [("manual_edit", "fat", "1", "9", "manual_edit"), ("manual_edit", "lc", None, "q", "manual_edit")]
    bad = ("invalid_manual_edit", "", "", "", "Invalid manual_edit chunk `bad`. Use field=value pairs.")
    assert sorted(map(str, got)) == sorted(map(str, [("suggested_fix", "fat", "1", "2", "s")] * 2 + edits * 3 + [bad] * 3))
    assert preview.where("source = 'suggested_fix' AND issue_id <> 'a'").isEmpty()
    assert preview.where("source = 'manual_edit' AND issue_id = 'c' AND old_value IS NULL").count() == 6
    assert "current_values" not in preview.drop("old_value")._jdf.queryExecution().executedPlan().toString()


def test_the_preview_query_writes_no_table(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(review_queries, "materialize", refuse)
    assert QUERIES["patch_preview"].run(spark, "/root/testdata/sf0.001").count() > 0


def test_ranks_and_reasons_by_templates_are_those_by_row(spark):
    """With and without feedback weights, for rules of their own weights, others, unknown and missing ones."""
    issues = _issues(spark)
    weights = [("fat_over_105g", "clamp_to_limit", -0.22), ("fat_over_105g", "clear_suspicious_value", 0.22),
               ("main_language_missing", "copy_existing_value", -0.125), ("no_such_rule", "manual_review_required", 0.0101),
               ("energy_kj_mismatch_low", "no_such_strategy", 0.1), ("energy_kj_computed_mismatch_high", "align_related_fields", 0.005)]
    table = spark.createDataFrame(weights, "rule_name string, fix_strategy string, weight double")
    for given in (table, table.limit(0)):
        plain = X.rank_fixes(X.with_fixes(B.attach_weights(issues, given))).drop("weights").select(*issues.columns, "fix_candidates")
        quick = X.with_ranked_fixes(issues, X.FIX.names, B.weights_by_rule(given))
        assert quick.columns == plain.columns
        assert sorted(map(str, quick.collect())) == sorted(map(str, plain.collect()))
        assert "sort_array" not in quick._jdf.queryExecution().optimizedPlan().toString()


def test_a_description_prints_the_values_of_its_rule_only(spark):
    """Parts are made once per rule; a row's plan holds one printing of numbers for all rules."""
    texts = {
        "sugars_over_105g": "Sugars is 110.5, above the allowed maximum of 105.", "unknown_over_105g": "Unknown is blank, above the allowed maximum of 105.",
        "saturated_fat_vs_fat": "Saturated fat (2) is greater than total fat (blank).", "main_language_missing": "Main language is blank for this product.",
        "sugars_plus_starch_vs_carbohydrates": "Sugars + starch (110.5 + 0.125) exceeds carbohydrates (-1).",
        "energy_kj_mismatch_low": "The recorded nutrition values do not fit the expected relationship: a < b.",
        "other": "This product violates the rule: a < b.", "no_condition": None}
    rules = spark.createDataFrame(
        [(name, None if name == "no_condition" else "a < b") for name in texts], "rule_name string, condition string").withColumn(
            "required_fields", F.array(F.lit("fat")))
    values = {"sugars": 110.5, "saturated_fat": 2.0, "starch": 0.125, "carbohydrates": -1.0}
    row = spark.range(1).select(*[
        F.lit(values.get(c, "p" if c == "product_id" else None)).cast(column_type(c)).alias(c) for c in PRODUCT_COLUMNS])
    found = I.build_issues(row.crossJoin(rules.select("rule_name")), rules)
    assert {r.rule_name: r.issue_description for r in found.collect()} == texts
    plan = found.select("issue_id", "issue_description")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_number") == 1
