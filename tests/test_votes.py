"""Votes counted before they are made, edits told without their values, and cells read few times."""
from __future__ import annotations

from pyspark.sql import functions as F

from rulemill.functions.edits import has_changes, parse_manual_edit
from rulemill.functions.status import fix_id_of_text, strip_fix_id
from rulemill.functions.text import normalize_optional_text, strip, strip_cell
from rulemill.operators import feedback as B
from rulemill.operators import review as R
from rulemill.registry import QUERIES
from rulemill.registry import all_queries  # noqa: F401  (fills QUERIES)

CELLS = "issue_id string, selected_fix_id string, user_action string, manual_edit string"
EDITS = ("", None, " nan", "fat=1", "fat:1; ;", "fat=1;broken", ";;", "{\"fat\": 1}", "{}", "{broken", "{\"a\": 1} x", "=", "broken\x0b;a=1",
         "　 a=b=c ", ";=;", "a=1;a=2;b=1;a=3")


def _issues(spark):
    fix = "array<struct<fix_id:string,fix_strategy:string>>"
    rows = [("i0", "p", "r0", [("a", "s0"), ("b", "s1"), ("c", "s2")]), ("i1", "p", "r0", [("a", "s0"), ("a", "s1"), ("b", "s2")]),
            ("i2", "p", None, [("a", "s0"), ("b", "s0"), ("c", "s1")]), ("i3", "p", "r1", [("a", None), ("b", "s1")]),
            ("i4", "p", "r1", [(None, "s0"), ("b", "s1")]), ("i5", "p", "r1", None), ("i6", "p", "r1", []), ("i0", "p", "r2", [("b", "s1")])]
    return spark.createDataFrame(rows, f"issue_id string, product_id string, rule_name string, fix_candidates {fix}")


def _sheet(spark):
    rows = [(issue, fix, action, edit) for issue in (" i0", "i1", "i2", "i3", "i4", "i5", "i6", "zz", "", None)
            for fix in ("a", " b | text", "none", "c|", "", None) for action in ("approve", " YES", "no", None) for edit in ("", "x=1", "bad")]
    sheet = spark.createDataFrame(rows, CELLS)
    return sheet.select("*", F.lit(0).cast("long").alias("row_idx"), F.lit("pending").alias("issue_status"),
                        *[F.lit("").alias(c) for c in ("review_notes", "reviewer_name", "reviewed_at_utc")])


def test_votes_counted_first_are_the_same_votes(spark):
    """Repeated issues and fix ids, missing ids, strategies and fixes, blank and unknown cells."""
    sheet, issues = _sheet(spark), _issues(spark)
    plain = B.count_votes(B.feedback_events(R.choices(sheet, issues)))
    counted = B.count_choices(R.vote_choices(sheet, issues))
    assert counted.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect())) and plain.count() > 8


def test_an_edit_has_changes_where_parsing_finds_some(spark):
    rows = spark.createDataFrame([(e,) for e in EDITS], "t string")
    got = rows.select(has_changes(F.coalesce(strip(F.col("t")), F.lit(""))).alias("has"),
                      (F.size(parse_manual_edit(F.col("t"))["changes"]) > 0).alias("parsed")).collect()
    assert [r.has for r in got] == [r.parsed for r in got] and {r.has for r in got} == {True, False}


def test_stripped_cells_are_the_same(spark):
    rows = spark.createDataFrame(
        [(x,) for x in ("", " ", "a", " a", "a　", "\x85a b", "é", "é ", " é", "a|b", " a | b", "none | b", "None", "| a", "|", None)],
        "t string")
    cell = F.coalesce(strip_cell(F.col("t")), F.lit(""))
    got = rows.select(strip_cell(F.col("t")).alias("a"), strip(F.col("t")).alias("b"), fix_id_of_text(cell).alias("c"),
                      strip_fix_id(normalize_optional_text(F.col("t"))).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


def test_counted_votes_parse_no_edit_and_states_are_tested_once(spark, tmp_path):
    _sheet(spark).write.parquet(str(tmp_path / "s"))
    _issues(spark).withColumn("current_values", F.create_map(F.lit("fat"), F.lit("1"))).withColumn(
        "fix_candidates", F.expr("transform(fix_candidates, f -> named_struct('fix_id', f.fix_id, 'target_field', 'fat', 'new_value',"
                                 " named_struct('kind', 'int', 'value', '1'), 'fix_strategy', f.fix_strategy))")).write.parquet(str(tmp_path / "i"))
    sheet, issues = (spark.read.parquet(str(tmp_path / n)) for n in "si")
    plan = R.vote_choices(sheet, issues)._jdf.queryExecution().optimizedPlan().toString()
    assert "schemaOfVariant" not in plan and "manual_edit" in plan
    preview = R.patch_preview(sheet, issues)
    plan = preview._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(lines" in plan and "Filter (isnotnull(state" in plan
    assert preview.count() > 0


def test_feedback_queries_count_choices_first(spark):
    for name in ("top_strategies", "feedback_summary", "feedback_counts", "flatten_feedback"):
        plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "chosen" in plan and "schemaOfVariant" not in plan, name


def test_rows_without_a_fix_or_an_edit_change_nothing(spark):
    sheet = _sheet(spark)
    issues = _issues(spark).withColumn("fix_candidates", F.expr(
        "transform(fix_candidates, f -> named_struct('fix_id', f.fix_id, 'target_field', 'fat', 'new_value', named_struct('kind', 'int', 'value', '1')))"))
    whole, few = (R.decisions(rows, issues).select("issue_id", "issue_status", F.inline("applied_changes")) for rows in (sheet, R.filled(sheet)))
    assert sorted(map(str, whole.collect())) == sorted(map(str, few.collect()))
    assert 0 < R.filled(sheet).count() < sheet.count()
